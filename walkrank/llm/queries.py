"""The numbered queries over the corpus tables: each applies its operator to a whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walkrank.llm import bpe, decontaminate, divergence, html_text, merkle, neardup, quality, substrings, token_files, topk, toxicity, urls, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: (host, path, verdict)
URL_RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.url_filter(pages, [urls.UrlRule(*r) for r in URL_RULES]).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM u),
r(host, path, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
j AS (SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
             row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.host || r.path) DESC NULLS LAST) AS n
      FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM j WHERE n = 1
"""


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


OP2_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep=["page_id", "url"])


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digests(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(documents, table(spark, sf_dir, "benchmark"), window=13, keep=["doc_id"])
    return decontaminate.digests(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP5_SQL = """
WITH w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
bi AS (SELECT item_id, ws, least(len(ws), 13) AS l, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS i FROM b WHERE len(ws) > 0),
bw AS MATERIALIZED (SELECT DISTINCT item_id, l, array_to_string(ws[i:i + l - 1], ' ') AS win FROM bi),
ls AS (SELECT DISTINCT l FROM bw),
di AS (SELECT r, l, ws, unnest(range(1, len(ws) - l + 2)) AS i FROM w, ls WHERE len(ws) >= l),
h AS MATERIALIZED (SELECT r, i, di.l, item_id FROM di JOIN bw ON di.l = bw.l AND array_to_string(ws[i:i + di.l - 1], ' ') = win),
p AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + l)) AS p FROM h) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n_items, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM h GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN p USING (r) LEFT JOIN t USING (r)
"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.train(documents, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(documents, machine, keep=["doc_id"])
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link_classes(table(spark, sf_dir, "documents"), words=5, percent=80)


OP7_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, least(len(ws), 1)) + 1)) AS i FROM w),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh FROM i),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), window=35, keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = """
WITH w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
i AS (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35),
s AS MATERIALIZED (SELECT r, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM i),
d AS (SELECT h FROM s GROUP BY h HAVING count(*) > 1),
c AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM s JOIN d USING (h)),
g AS (SELECT r, list(p) AS ps FROM c GROUP BY r),
k AS (SELECT doc_id, ws, coalesce(len(ps), 0) AS n, list_filter(ws, lambda x, j: ps IS NULL OR NOT list_contains(ps, j)) AS kept FROM w LEFT JOIN g USING (r))
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(n AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return archive.read().select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, n AS payload_bytes, sha256(html) AS payload_digest, CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to FROM m
"""


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least=10, top=10)


OP11_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
g AS (SELECT DISTINCT lang, source FROM d),
k AS MATERIALIZED (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(k.term) AS v FROM (SELECT DISTINCT lang FROM g) LEFT JOIN k USING (lang) GROUP BY lang),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS c FROM w JOIN k USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, CAST(coalesce(sum(c), 0) AS HUGEINT) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(c.c, 0) + 2) // (n.n + 2 * v.v) AS p
  FROM g JOIN k USING (lang) JOIN v USING (lang) JOIN n USING (lang, source) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(c)::HUGEINT + 2) // (any_value(t) + 2 * any_value(v)) AS q FROM p JOIN (SELECT lang, sum(n) AS t FROM n GROUP BY 1) USING (lang) JOIN v USING (lang) GROUP BY ALL),
f AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
t AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
u AS (SELECT lang, source, 'pair' AS part, item, value FROM f UNION ALL SELECT lang, source, 'term', item, value FROM t),
r AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
SELECT * FROM r WHERE part = 'pair' OR rank <= 10
"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    documents = table(spark, sf_dir, "documents").select(*fields)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaf = merkle.leaf_digest(*map(F.col, fields))
    claim = F.when(tampered, merkle.leaf_digest(*map(F.col, fields[:-1]), lowered)).otherwise(leaf)
    rows = merkle.proofs(merkle.build(documents.withColumn("claim", claim), leaf, keep=["doc_id", "claim"]))
    folded = rows.select(F.col("row.doc_id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), merkle.fold(F.col("row.claim"), F.col("path")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def _op12_sql(levels: int = 6, upper: int = 4) -> str:
    """Trees of at most 16^levels rows, and of 16^upper sources, level by level. A level that has one node stays as it is."""

    def tree(name: str, n: int) -> str:
        return "".join(
            f"""{name}r{i} AS MATERIALIZED (SELECT tree, idx // 16 AS up, any_value(size) AS size, list(d ORDER BY idx) AS run FROM {name}{i} GROUP BY ALL),
{name}{i + 1} AS (SELECT tree, up AS idx, CASE WHEN size > 1 THEN (size + 15) // 16 ELSE 1 END AS size, CASE WHEN size > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS d FROM {name}r{i}),
"""
            for i in range(n)
        )

    def climb(rows: str, name: str, n: int, to: str) -> str:
        """Proof and folded digest of each row, level by level."""
        out = ""
        for i in range(n):
            before, after = f"array_to_string(run[1:spot % 16], '')", f"array_to_string(run[spot % 16 + 2:], '')"
            source = rows if i == 0 else f"{to}{i - 1}"
            out += f"""{to}{i} AS (SELECT x.* EXCLUDE (spot, proof, own), spot // 16 AS spot, CASE WHEN size > 1 THEN proof || {before} || {after} ELSE proof END AS proof, CASE WHEN size > 1 THEN sha256({before} || own || {after}) ELSE own END AS own FROM {source} x JOIN {name}r{i} y ON x.tree = y.tree AND x.spot // 16 = y.up),
"""
        return out

    value = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR) END"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    head = " || ".join(value(c) for c in ("doc_id", "source", "lang", "n_chars"))
    shift = "CASE WHEN {c} & 1 = 1 THEN xor({c} >> 1, 3988292384) ELSE {c} >> 1 END"
    crc = "i"
    steps = ""
    for k in range(8):
        steps += f"s{k} AS (SELECT i, {shift.format(c=crc)} AS c FROM {'bytes' if k == 0 else f's{k - 1}'}),\n"
        crc = "c"
    return f"""WITH bytes AS (SELECT CAST(unnest(range(256)) AS BIGINT) AS i),
{steps}crcs AS (SELECT list(c ORDER BY i) AS t FROM s7),
h AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '-') AS name, sha256({head} || {value("text")}) AS leaf, sha256({head} || {value(low)}) AS lowered,
  coalesce(xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]), 4294967295), 4294967295) % 5 = 0, false) AS tampered FROM documents, crcs),
trees AS (SELECT name, n, row_number() OVER (ORDER BY name) - 1 AS tree FROM (SELECT name, count(*) AS n FROM h GROUP BY 1)),
p AS MATERIALIZED (SELECT r, doc_id, tree, n AS size, leaf, CASE WHEN tampered THEN lowered ELSE leaf END AS claim, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM h JOIN trees USING (name)),
a0 AS (SELECT tree, idx, size, leaf AS d FROM p),
{tree("a", levels)}b0 AS (SELECT 0 AS tree, tree AS idx, (SELECT count(*) FROM trees) AS size, d FROM a{levels}),
{tree("b", upper)}c AS (SELECT r, doc_id, tree, leaf, idx AS spot, '' AS proof, claim AS own FROM p),
{climb("c", "a", levels, "up")}e AS (SELECT u.r, u.doc_id, 0 AS tree, u.tree AS spot, u.leaf, s.d AS subroot, u.proof, u.own FROM up{levels - 1} u JOIN a{levels} s ON s.tree = u.tree),
{climb("e", "b", upper, "top")}z AS (SELECT d AS root FROM b{upper})
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, own AS folded_root, own = root AS verified FROM top{upper - 1}, z"""


OP12_SQL = _op12_sql()


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return quality.host_quality(documents, keep=["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _op13_sql() -> str:
    rules = quality.RULES
    each = lambda text: ", ".join(text.format(r=r.name, fails=r.fails, limit=r.limit) for r in rules)
    low, high = quality.STRENGTH
    return f"""WITH w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
i AS (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5),
s AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS s FROM i),
m AS (SELECT r, i FROM s QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM m) GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM w),
b AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
k AS MATERIALIZED (SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(length(array_to_string(ws, '')), 0) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN c USING (r) LEFT JOIN b USING (r)),
h AS (SELECT source, count(*) AS n, {each("CAST(count(*) FILTER ({fails}) AS DOUBLE) AS f_{r}")} FROM k GROUP BY source),
t AS (SELECT CAST(count(*) AS DOUBLE) AS hosts, CAST(sum(n) AS DOUBLE) AS docs, sum(CAST(n AS DOUBLE) * n) AS squares, {each("sum(f_{r}) / sum(n) AS m_{r}, sum(f_{r} * f_{r} / n) - sum(f_{r}) * sum(f_{r}) / sum(n) AS s_{r}")} FROM h),
e AS (SELECT *, docs - squares / docs - (hosts - 1) AS room, {each("s_{r} - (hosts - 1) * m_{r} * (1 - m_{r}) AS x_{r}, m_{r} * (1 - m_{r}) AS v_{r}")} FROM t),
a AS (SELECT *, {each(f"CASE WHEN x_{{r}} > 0 AND v_{{r}} > 0 AND room > 0 THEN least({high}e0, greatest({low}e0, v_{{r}} * room / x_{{r}} - 1)) ELSE {high}e0 END AS a_{{r}}")} FROM e),
g AS (SELECT source, {" OR ".join(f"((f_{r.name} + m_{r.name} * a_{r.name}) / (n + a_{r.name}) > {r.limit}e0 AND f_{r.name} > {r.limit}e0 * n)" for r in rules)} AS bad FROM h, a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {" OR ".join(f"({r.fails})" for r in rules if r.alone)} AS base_failed, NOT ({" OR ".join(f"({r.fails})" for r in rules if r.alone)} OR bad) AS kept
FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source"""


OP13_SQL = _op13_sql()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filters, op2_exact_topk, op3_html_extraction, op4_token_files, op5_decontamination, op6_toxicity, op7_ngram_jaccard, op8_substring_dedup, op9_bpe, op10_warc, op11_source_divergence, op12_merkle_manifest, op13_quality_rules)}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": OP1_SQL, "op2_exact_topk": OP2_SQL, "op5_decontamination": OP5_SQL, "op7_ngram_jaccard": OP7_SQL, "op8_substring_dedup": OP8_SQL, "op10_warc": OP10_SQL, "op11_source_divergence": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_quality_rules": OP13_SQL}
