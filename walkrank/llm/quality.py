"""Quality rules of hosts: failures of documents are counted by host, rates shrink towards an empirical beta prior, and verdicts go back to the documents."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from walkrank.llm.scratch import Scratch, bounded, small
from walkrank.llm.words import NOT_SPACE, hashes, mix, offsets, pieces, run_hashes, split, windows

COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
#: Words of a window that may repeat within a text.
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
#: Documents that a prior weighs as at least and at most; the most where hosts don't differ by more than chance.
STRENGTH = (10.0, 1000.0)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_NEWLINE = 0x0A


class Rule(NamedTuple):
    """``fails``: SQL over COUNTS, true for a document that fails. ``alone``: such a document goes by itself. ``limit``: the share of failing documents above which all of a host go."""

    name: str
    fails: str
    alone: bool = False
    limit: float = 0.5


RULES = (
    Rule("short", "n_words < 10", alone=True),
    Rule("repeated", "100 * n_repeat_words > 20 * n_words", alone=True),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
)


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags are set in each run between ``at``."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def _again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key, whether it occurs more than once, and whether it has occurred before."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    before, more = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    before[order[1:]] = same
    more[order[1:]] |= same
    more[order[:-1]] |= same
    return more, before


def count_batch(column: pa.Array) -> list[np.ndarray]:
    """COUNTS of each text; windows and lines are compared within a text by 64-bit hashes."""
    at, data = offsets(column)
    words = split(column)
    inside = NOT_SPACE[data]
    n, row = len(words.starts), words.row()
    repeated = np.zeros(n + 1, np.int64)
    if n >= WINDOW:
        whole = np.flatnonzero(row[: n - WINDOW + 1] == row[WINDOW - 1 :])
        more, _ = _again(mix(windows(hashes(words), WINDOW)[whole] ^ mix(row[whole].astype(np.uint64) + np.uint64(1))))
        repeated[whole[more]] += 1
        np.subtract.at(repeated, whole[more] + WINDOW, 1)
    # a line ends before each \n and at the end of its text
    stops = np.union1d(np.flatnonzero(data == _NEWLINE), at[1:][at[1:] > at[:-1]])
    starts = np.concatenate([[0], stops[:-1] + (data[stops[:-1]] == _NEWLINE)]) if len(stops) else stops
    total = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
    told = total[stops] > total[starts]
    starts, stops = starts[told], stops[told]
    line_row = np.searchsorted(at, starts, "right") - 1
    _, before = _again(mix(run_hashes(data, starts, stops) ^ mix(line_row.astype(np.uint64) + np.uint64(1))))
    n_rows = len(at) - 1
    return [
        np.diff(words.first),
        _sums(inside & ((data & 0xC0) != 0x80), at),
        _sums(_SYMBOL[data], at),
        np.bincount(line_row, minlength=n_rows),
        np.bincount(line_row[before], minlength=n_rows),
        _sums(np.cumsum(repeated[:-1]) > 0, words.first),
    ]


def count_rules(frame: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The rows with COUNTS of each whole text, in one narrow pass; null texts count as empty. Columns of these names are replaced; ``keep`` names those to return besides (all)."""
    bounded(frame.sparkSession)
    keep = [c for c in (frame.columns if keep is None else keep) if c not in COUNTS]
    types = {f.name: f for f in frame.schema.fields}
    schema = T.StructType([*(types[c] for c in keep), *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def run(batches):
        for batch in pieces(batches, text):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(x.astype(np.int64)) for x in count_batch(batch.column(text)))], names=schema.names)

    return frame.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*keep, text]))).mapInArrow(run, schema)


def prior(failed: float, docs: float, squares: float, scatter: float, hosts: int) -> tuple[float, float]:
    """(mean, strength) of the beta prior of hosts' rates, by moments.

    ``failed`` and ``docs`` are sums over hosts, ``squares`` that of squared
    numbers of documents, ``scatter`` that of failed^2 / documents. The
    variance between hosts is what exceeds the binomial one; without any, the
    prior is as strong as it may be.
    """
    if not docs:
        return 0.0, STRENGTH[1]
    mean = failed / docs
    spread, room = mean * (1 - mean), docs - squares / docs - (hosts - 1)
    extra = scatter - failed * failed / docs - (hosts - 1) * spread
    if extra <= 0 or spread <= 0 or room <= 0:
        return mean, STRENGTH[1]
    return mean, min(STRENGTH[1], max(STRENGTH[0], spread * room / extra - 1))


def host_rates(counted: DataFrame, host: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(host, n, a column a rule with its failures): partial sums, so a host of any share of the rows is no hot spot."""
    return counted.groupBy(host).agg(F.count("*").alias("n"), *(F.count_if(F.expr(r.fails)).alias(f"failed_{r.name}") for r in rules))


def judged(rates: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The hosts with a column a rule, rate_<name>: the shrunk rate; and host_rules: names of the rules by which all of the host go.

    That is where both the shrunk rate and the host's own exceed the limit, so
    that a host of few documents isn't judged by the others alone.
    """
    sums = [F.count("*").alias("hosts"), F.sum("n").alias("docs"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares")]
    for r in rules:
        failed = F.col(f"failed_{r.name}").cast("double")
        sums += [F.sum(failed).alias(f"sum_{r.name}"), F.sum(failed * failed / F.col("n")).alias(f"scatter_{r.name}")]
    all_hosts: Row = rates.agg(*sums).first()  # one row, whatever the number of hosts
    verdicts: list[Column] = []
    for r in rules:
        mean, strength = prior(all_hosts[f"sum_{r.name}"] or 0.0, all_hosts["docs"] or 0, all_hosts["squares"] or 0.0, all_hosts[f"scatter_{r.name}"] or 0.0, all_hosts["hosts"])
        rates = rates.withColumn(f"rate_{r.name}", (F.col(f"failed_{r.name}") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength)))
        bad = (F.col(f"rate_{r.name}") > r.limit) & (F.col(f"failed_{r.name}") > F.lit(r.limit) * F.col("n"))
        verdicts.append(F.when(bad, F.lit(r.name)))
    return rates.withColumn("host_rules", F.array_compact(F.array(*verdicts)))


def host_quality(frame: DataFrame, text: str = "text", host: str = "source", keep: list[str] | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows with COUNTS, base_failed (a rule that counts alone fails), host_rules (names of the rules by which their host goes) and kept (neither).

    Null and empty texts have no words and fail as short; rows without a host
    are a host of their own; repeated rows each count; an empty table gives an
    empty result. Columns of these names are replaced. Counts are written
    once, without texts unless ``keep`` names them (all columns but the text).
    """
    spark = frame.sparkSession
    made = [*COUNTS, "base_failed", "host_rules", "kept"]
    keep = [c for c in (frame.columns if keep is None else keep) if c not in made and (keep is not None or c != text)]
    scratch = Scratch(spark, "quality")
    source = frame.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])), F.col(f"`{host}`").cast("string").alias("__host"))
    counted = scratch.save(count_rules(source, text, [*keep, "__host"]), "counts")
    hosts = scratch.save(judged(scratch.save(host_rates(counted, "__host", rules), "rates"), rules), "hosts")
    # only hosts that go are joined back; a host may be null
    gone = hosts.where(F.size("host_rules") > 0).select(F.struct("__host").alias("__key"), "host_rules")
    alone = [F.expr(r.fails) for r in rules if r.alone]
    failed = F.lit(False)
    for condition in alone:
        failed = failed | condition
    rows = counted.withColumn("__key", F.struct("__host")).join(small(gone, gone.count()), "__key", "left")
    rows = rows.withColumn("base_failed", failed).withColumn("host_rules", F.coalesce("host_rules", F.array().cast("array<string>")))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("host_rules") == 0)).select(*keep, *made)
