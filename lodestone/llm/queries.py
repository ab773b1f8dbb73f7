"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_extract, langid, secrets, toxicity
from .common import fold, new_path, table
from .exact_dedup import exact_dedup
from .mixing import mix
from .near_dedup import near_groups
from .sharding import shard
from .substrings import repeated_passages


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold("doc_id", 4) != 2))
    out = langid.identify(docs, model)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "mixture", "n_langs")


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(fold("doc_id", 5) != 0))
    out = toxicity.score(docs, model)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted", F.to_json("evidence").alias("evidence"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"), new_path(spark, "shards"))
    return out.select("doc_id", F.octet_length("text").cast("long").alias("text_bytes"), "shard", "shard_rows", "shard_bytes", "version")


def queries() -> dict:
    return {f.__name__: f for f in (op1_language, op2_main_text, op3_decontaminate, op4_toxicity, op5_near_dedup, op6_secrets, op7_mix_sources, op8_repeated_passages, op9_exact_dedup, op10_shards)}


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP5_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS nboth FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * nboth >= 75 * (a.n + b.n - nboth)
), r(doc_id, there) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.there = e.x
), c AS (SELECT doc_id, min(there) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP9_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t
)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""


#: Rules as RE2 sees them: kind, pattern, least length, group that is measured.
SECRET_RULES = (
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    ("access", r"AKIA[A-Z0-9]+", 16, 0),
    ("hex", r"[0-9a-f]+", 32, 0),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 36, 0),
    ("hub", r"gh[pousr]_[A-Za-z0-9]+", 40, 0),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]+", 20, 0),
)


def _secrets_sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    found = " UNION ALL ".join(f"SELECT doc_id, {k} AS k, {quote(kind)} AS kind, regexp_extract_all(t, {quote(p)}) AS m, string_split_regex(t, {quote(p)}) AS s FROM t" for k, (kind, p, _, _) in enumerate(SECRET_RULES))
    long = " ".join(f"WHEN {k} THEN length(regexp_extract(v, {quote(p)}, {g})) >= {n}" for k, (_, p, n, g) in enumerate(SECRET_RULES))
    joined = "string_agg(concat(kind, ':', st, ':', en), ',' ORDER BY st, k)"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), u AS ({found}),
x AS (SELECT doc_id, k, kind, m, s, unnest(range(1, len(m) + 1)) AS i FROM u WHERE len(m) > 0),
y AS (SELECT doc_id, k, kind, m[i] AS v, (list_sum(list_transform(s[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i-1], lambda z: length(z))), 0))::BIGINT AS st FROM x),
z AS (SELECT doc_id, k, kind, st, st + length(v) AS en FROM y WHERE CASE k {long} END)
SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce({joined} FILTER (k < 3), '')) AS base_sha256, coalesce({joined} FILTER (k IS NOT NULL), '') AS spans FROM t LEFT JOIN z USING (doc_id) GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_near_dedup": OP5_SQL, "op6_secrets": _secrets_sql(), "op9_exact_dedup": OP9_SQL}
