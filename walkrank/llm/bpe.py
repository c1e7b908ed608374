"""Byte-pair encoding by dynamic programming over prefixes, and decoding."""

from __future__ import annotations

import hashlib
import json
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walkrank.llm.token_files import LONGEST, Kept, byte_alphabet, distinct_runs, joined
from walkrank.llm.scratch import bounded
from walkrank.llm.words import NOT_SPACE, offsets, pieces, split

#: The pattern of byte-level vocabularies that splits a text before pairs are merged. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pair tests of which each worker process keeps the outcome.
TESTS = 200_000


class PrefixEncoder:
    """Exact byte-pair encoding without merging.

    The encoding of a prefix has one last token; an automaton over the
    vocabulary gives the tokens that are suffixes of the prefix, and one of
    them is right if what stands before it ends in a token that may stand next
    to it. Following the last tokens backwards gives all ids.
    """

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        size = max(vocabulary.values()) + 1
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.pairs: dict[int, int] = {}  # the rank of a pair that merges
        for rank, (a, b) in enumerate(merges):
            token, a, b = vocabulary[a + b], vocabulary[a], vocabulary[b]
            self.pairs[a << 32 | b] = rank
            if self.rank[token] < 0:
                self.rank[token], self.left[token], self.right[token] = rank, a, b
        self.alone: dict[int, bool] = {}
        self.length = [0] * size
        self.automaton = ahocorasick.Automaton()
        for text, token in vocabulary.items():
            self.length[token] = len(text)
            if (len(text) == 1 or self.rank[token] >= 0) and self.whole(token):  # no other is in any encoding
                self.automaton.add_word(text, (token, len(text), {}))  # and what was tested before it
        self.automaton.make_automaton()
        self.alphabet = byte_alphabet()
        self.blank = self.alphabet[0x20]
        back = {c: b for b, c in self.alphabet.items()}
        self.bytes_of = [b""] * size
        for text, token in vocabulary.items():
            self.bytes_of[token] = bytes(back[c] for c in text) if all(c in back for c in text) else text.encode()
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for text, token in self.added.items():
            self.bytes_of += [b""] * (token + 1 - len(self.bytes_of))
            self.bytes_of[token] = text.encode()
        self.split = regex.compile(PATTERN).findall
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else lambda t: [t]
        self.tested: list[dict[int, bool]] = []
        self.words, self.chunks = Kept(), Kept()

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging by rank leaves a boundary between tokens a and b that stand side by side.

        Goes back in time through the merges of both: whenever the tokens at
        the boundary lived side by side, a merge of them that came before
        either was used up would have crossed it. Times are twice the rank; a
        merge to the left of the boundary comes before one across it of equal
        rank, and that before one to the right.
        """
        rank, pairs, until = self.rank, self.pairs, 1 << 62
        while True:
            across = pairs.get(a << 32 | b)
            if across is not None and 2 * across < until:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                until, a = 2 * rank[a], self.right[a]
            else:
                until, b = 2 * rank[b] + 1, self.left[b]

    def whole(self, token: int) -> bool:
        """Whether a token's own text is encoded as that token."""
        known = self.alone.get(token)
        if known is None:
            known = self.rank[token] < 0 or (self.whole(self.left[token]) and self.whole(self.right[token]) and self._first_to_cross(self.left[token], self.right[token]))
            self.alone[token] = known
        return known

    def _first_to_cross(self, a: int, b: int) -> bool:
        """Whether the first merge across the boundary of a and b is that of a and b themselves."""
        own, rank, until = self.pairs[a << 32 | b], self.rank, 1 << 62
        x, y = a, b
        while True:
            across = self.pairs.get(x << 32 | y)
            if across is not None and (x, y) != (a, b) and 2 * across < until:
                return False
            if rank[x] < 0 and rank[y] < 0:
                return own >= max(rank[a], rank[b])
            if rank[x] > rank[y]:
                until, x = 2 * rank[x], self.right[x]
            else:
                until, y = 2 * rank[y] + 1, self.left[y]

    def word(self, piece: str) -> bytes:
        """The ids of one piece of the pattern, as unsigned 32-bit integers."""
        if (ids := self.words.get(piece)) is not None:
            return ids
        if piece.isascii() and piece.isprintable():  # of these only a blank has another character
            mapped = piece.replace(" ", self.blank)
        else:
            alphabet = self.alphabet
            mapped = "".join([alphabet[b] for b in piece.encode()])
        found = self.automaton.get(mapped, None)
        if found is not None:  # the last token of the longest prefix, with nothing before it
            ids = array("I", found[:1]).tobytes()
            self.words.put(piece, ids)
            return ids
        length = self.length
        last = [-1] * (len(mapped) + 1) if len(mapped) <= LONGEST else array("i", [-1]) * (len(mapped) + 1)
        for end, (token, size, fits) in self.automaton.iter(mapped):
            end += 1
            if last[end] >= 0:
                continue
            if end != size:
                before = last[end - size]
                if before < 0:
                    continue
                ok = fits.get(before)
                if ok is None:
                    ok = fits[before] = self.compatible(before, token)
                    self.tested.append(fits)
                if not ok:
                    continue
            last[end] = token
        ids, at = array("I"), len(mapped)
        while at > 0:
            ids.append(last[at])
            at -= length[last[at]]
        ids.reverse()
        ids = ids.tobytes()
        self.words.put(piece, ids)
        return ids

    def chunk(self, text: str) -> bytes:
        """The ids of a text without added tokens."""
        body = text[1:] if text[:1] == " " else text
        if body.isalpha() and max(body) < "\u0250":  # Latin letters alone are one piece of the pattern
            return self.word(text)
        return b"".join([self.word(piece) for piece in self.split(text)])

    def text(self, text: str) -> bytes:
        """The ids of any text; added tokens in it count as such."""
        return b"".join([array("I", [self.added[part]]).tobytes() if part in self.added else self.chunk(part) for part in self.split_added(text)])


_open: dict[str, PrefixEncoder] = {}


def encoder(path: str) -> PrefixEncoder:
    return _open.get(path) or _open.setdefault(path, PrefixEncoder(path))


def _odd(data: np.ndarray, added: list[bytes]) -> np.ndarray:
    """Where bytes begin white space beyond ASCII or an added token: such texts are split as a whole."""
    at = [np.flatnonzero((data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0)))]
    lead = np.flatnonzero((data[:-2] >= 0xE1) & (data[:-2] <= 0xE3)) if len(data) > 2 else np.zeros(0, np.int64)
    a, b, c = data[lead], data[lead + 1], data[lead + 2]
    space = ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80)) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F))
    space |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    at.append(lead[space])
    for token in added:
        hit = np.flatnonzero(data == token[0])
        for i, byte in enumerate(token):
            hit = hit[hit + i < len(data)]
            hit = hit[data[hit + i] == byte]
        at.append(hit)
    return np.concatenate(at)


def _encode_batch(coder: PrefixEncoder, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of texts, and their offsets by row."""
    words = split(column, NOT_SPACE)
    data, n = words.data, len(words.first) - 1
    at, _ = offsets(column)
    odd_rows = np.unique(np.searchsorted(at, _odd(data, [a.encode() for a in coder.added]), "right") - 1) if len(data) > 1 else np.zeros(0, np.int64)
    # a word takes a blank right before it along; what is left of the white space stands alone: all but the last
    # character, and the last, where a word follows that didn't take it
    row = words.row()
    before = words.starts - 1
    blank = (before >= at[row]) & (data[np.maximum(before, 0)] == 0x20)
    starts = words.starts - blank
    # gaps: from the end of the word before (or the row's start) to this word's start, and from the last word to the row's end
    gap_from = np.concatenate([[0], words.ends[:-1]]) if len(starts) else np.zeros(0, np.int64)
    head = np.zeros(len(starts), bool)
    head[words.first[:-1][np.diff(words.first) > 0]] = True
    gap_from = np.where(head, at[row], gap_from)
    single = ~blank & (starts > gap_from)
    body_from, body_to = gap_from, starts - single  # all but the last character, if no blank was taken
    tail_rows = np.arange(n)
    tail_from = np.where(np.diff(words.first) > 0, words.ends[np.maximum(words.first[1:] - 1, 0)] if len(words.ends) else 0, at[:-1])
    runs_s = np.concatenate([starts, body_from[body_to > body_from], (starts - 1)[single], tail_from[at[1:] > tail_from]])
    runs_e = np.concatenate([words.ends, body_to[body_to > body_from], starts[single], at[1:][at[1:] > tail_from]])
    runs_r = np.concatenate([row, row[body_to > body_from], row[single], tail_rows[at[1:] > tail_from]])
    if len(odd_rows):
        regular = np.ones(n, bool)
        regular[odd_rows] = False
        regular = regular[runs_r]
        runs_s, runs_e, runs_r = runs_s[regular], runs_e[regular], runs_r[regular]
    order = np.argsort(runs_s, kind="stable")
    runs_s, runs_e, runs_r = runs_s[order], runs_e[order], runs_r[order]
    chunks, of = distinct_runs(data, runs_s, runs_e)
    if len(coder.tested) > TESTS:
        for fits in coder.tested:
            fits.clear()
        coder.tested.clear()
    kept = coder.chunks
    ids = []
    for c in chunks:
        got = kept.get(c)
        if got is None:
            got = coder.chunk(c.decode())
            kept.put(c, got)
        ids.append(got)
    flat, sizes = joined(ids, of)
    flat = flat.view("<u4")
    count = np.bincount(runs_r, sizes, n).astype(np.int64) if len(of) else np.zeros(n, np.int64)
    if len(odd_rows):
        whole = {r: np.frombuffer(coder.text(data[at[r] : at[r + 1]].tobytes().decode()), "<u4") for r in odd_rows.tolist()}
        ends = np.cumsum(count)
        flat = np.concatenate([np.concatenate([flat[lo:hi], whole[r]]) for r, lo, hi in zip(odd_rows.tolist(), np.concatenate([[0], ends[odd_rows[:-1]]]), ends[odd_rows], strict=True)] + [flat[ends[odd_rows[-1]] :]])
        count[odd_rows] = [len(whole[r]) for r in odd_rows.tolist()]
    return flat, np.concatenate([[0], np.cumsum(count)])


def _decode_batch(coder: PrefixEncoder, flat: np.ndarray, at: np.ndarray) -> list[bytes]:
    """The text of each row's ids, in UTF-8; bytes that are none become U+FFFD."""
    table = coder.bytes_of
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        out.append(b"".join([table[i] for i in flat[a:b].tolist()]).decode("utf-8", "replace").encode())
    return out


def bpe_encode(frame: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids array<int>) of each whole text, one row each. Null counts as empty, and empty texts have no ids; repeated rows each give a row; an empty table gives an empty result; other columns are not read."""

    bounded(frame.sparkSession)

    def run(batches):
        coder = encoder(tokenizer)
        for batch in pieces(batches, "text"):
            flat, at = _encode_batch(coder, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.astype(np.int32)))], names=["doc_id", "ids"])

    return frame.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def bpe_decode(frame: DataFrame, tokenizer: str, ids: str = "ids", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text) of each list of ids, one row each; bytes that are no UTF-8 become U+FFFD. Null lists count as empty; repeated rows each give a row; an empty table gives an empty result; other columns are not read. Ids must be those of the vocabulary."""

    bounded(frame.sparkSession)

    def run(batches):
        coder = encoder(tokenizer)
        for batch in batches:
            lists = batch.column("ids").fill_null([]) if batch.column("ids").null_count else batch.column("ids")
            texts = _decode_batch(coder, lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t.decode() for t in texts], pa.string())], names=["doc_id", "text"])

    return frame.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, "doc_id bigint, text string")


def bpe_round_trip(frame: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row: encoded, then decoded from the ids.

    One narrow pass: ids don't leave the task. Null texts count as empty;
    repeated rows each give a row; an empty table gives an empty result.
    """

    bounded(frame.sparkSession)

    def run(batches):
        coder = encoder(tokenizer)
        for batch in pieces(batches, "text", 1 << 20):
            flat, at = _encode_batch(coder, batch.column("text"))
            ids = [hashlib.sha256(flat[a:b].astype("<u4").tobytes()).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            texts = [hashlib.sha256(t).hexdigest() for t in _decode_batch(coder, flat, at)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return frame.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
