"""Queries of the corpus operators, with their SQL where SQL can state them."""

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_round_trip
from .chat_format import PART, format_chat, masked, read_back
from .exact_dedup import exact_dedup
from .filter_audit import filter_audit, quality_flags, with_labels
from .jaccard_join import jaccard_groups
from .line_dedup import ROLL, line_dedup
from .mixing import mix_sources
from .quality import score_quality
from .search import bm25_top_k
from .secret_scan import scan_secrets
from .shared import table
from .substring_dedup import substring_dedup
from .toxicity import score_toxicity
from .vector_codes import compress_vectors


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, i, r, "</s>[INST] ok [/INST]") for i, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    part = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))])
    done = format_chat(rows.unionByName(own).withColumn("parts", F.array(part.cast(PART))))
    read = done.withColumn("turns", read_back(F.col("formatted"))).withColumn("loss", masked(F.col("formatted"), F.col("loss_mask")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP2_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
made AS (
  SELECT *, '<|turn:' || role || '|>' || replace(replace(replace(text, '\', '\s'), '<', '\l'), '[', '\b') || '<|end|>' AS piece FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  length(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length(piece)) AS BIGINT) AS formatted_chars
FROM made GROUP BY conv_id
"""


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(words) - 48)) AS pos, words FROM d WHERE len(words) >= 50),
h AS (SELECT doc_id, pos, sha256(array_to_string(words[pos:pos + 49], ' ')) AS win FROM w),
f AS (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY win) AS least FROM h),
g AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(pos, pos + 50)) AS p FROM f WHERE least < doc_id)),
k AS (SELECT d.doc_id, len(words) AS n_words, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM d),
j AS (SELECT k.*, g.p IS NOT NULL AS gone FROM k LEFT JOIN g ON k.doc_id = g.doc_id AND k.p = g.p),
r AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(CASE WHEN NOT gone THEN word END, ' ' ORDER BY p) AS kept FROM j GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(r.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256
FROM d LEFT JOIN r ON d.doc_id = r.doc_id
"""


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = scan_secrets(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return done.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_chunks", "n_cut", "lines_cut", "chars_cut", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP5_SQL = rf"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, list_transform(lines, lambda l: ('0x' || substr(md5(l), 1, 7))::BIGINT) AS hash FROM d),
e AS (SELECT *, list_filter(range(1, len(lines) + 1), lambda i: i = len(lines)
  OR ((hash[i] + CASE WHEN i > 1 THEN {ROLL[0]} * hash[i - 1] ELSE 0 END + CASE WHEN i > 2 THEN {ROLL[1]} * hash[i - 2] ELSE 0 END) % {ROLL[2]}) % 4 = 0) AS ends FROM h),
c AS (SELECT *, list_filter(range(1, len(lines) + 1), lambda i: trim(lines[i], ' ') <> '') AS nonblank FROM e),
x AS (SELECT doc_id, lines, CASE WHEN k = 1 THEN 1 ELSE ends[k - 1] + 1 END AS f, ends[k] AS t FROM (SELECT *, unnest(range(1, len(ends) + 1)) AS k FROM c)
  WHERE len(list_filter(nonblank, lambda i: i <= ends[k] AND i > CASE WHEN k = 1 THEN 0 ELSE ends[k - 1] END)) >= 2
  UNION SELECT doc_id, lines, nonblank[k], nonblank[k + 1] FROM (SELECT *, unnest(range(1, len(nonblank))) AS k FROM c)),
o AS (SELECT doc_id, f, t, row_number() OVER (PARTITION BY array_to_string(lines[f:t], chr(10)) ORDER BY doc_id, f) AS nth FROM x),
n AS (SELECT doc_id, count(*) AS n_cut FROM o WHERE nth > 1 GROUP BY doc_id),
g AS (SELECT DISTINCT doc_id, unnest(range(f, t + 1)) AS p FROM o WHERE nth > 1),
l AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS p, unnest(lines) AS line FROM d),
r AS (SELECT doc_id, count(g.p) AS lines_cut, string_agg(CASE WHEN g.p IS NULL THEN line END, chr(10) ORDER BY p) AS kept FROM l LEFT JOIN g USING (doc_id, p) GROUP BY doc_id)
SELECT a.doc_id, CAST(coalesce(len(c.ends), 0) AS BIGINT) AS n_chunks, CAST(coalesce(n.n_cut, 0) AS BIGINT) AS n_cut, CAST(coalesce(r.lines_cut, 0) AS BIGINT) AS lines_cut,
  CAST(length(coalesce(a.text, '')) - length(coalesce(r.kept, '')) AS BIGINT) AS chars_cut, sha256(coalesce(r.kept, '')) AS kept_sha256
FROM documents a LEFT JOIN r USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents")).drop("class_id")


OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
  ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * both_have >= 80 * (x.n + y.n - both_have)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = d.doc_id
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).drop("text")


def op8_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_top_k(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT count(*) AS n, sum(len(words)) / count(*) AS average FROM d),
t AS (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest(words) AS word FROM d) GROUP BY doc_id, word),
f AS (SELECT word, count(*) AS df, ln(1 + (max(g.n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM t, g GROUP BY word),
q AS (SELECT t.doc_id AS query_id, t.word, f.idf FROM t JOIN f USING (word) WHERE t.doc_id % 50 = 0),
s AS (SELECT q.query_id, t.doc_id, round(sum(q.idf * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * len(d.words) / g.average))), 9) AS score
  FROM q JOIN t USING (word) JOIN d ON d.doc_id = t.doc_id, g GROUP BY q.query_id, t.doc_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10
"""


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    done = bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = exact_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d
"""


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(table(spark, sf_dir, "embeddings")).drop("label")


#: One round: the nearest entry of each part (the lower index on a tie), and then the entries' floored means.
OP11_ROUND = """
a{r} AS (SELECT rid, part, arg_min(e, far * 256 + e) AS e, min(far) AS far FROM (
  SELECT p.rid, p.part, b.e, CAST(list_inner_product(p.w, p.w) - 2 * list_inner_product(p.w, b.w) + list_inner_product(b.w, b.w) AS BIGINT) AS far
  FROM p JOIN b{r} b ON p.part = b.part) GROUP BY rid, part)"""
OP11_MEANS = """
m{r} AS (SELECT part, e, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS w FROM (
  SELECT a.part, a.e, i, sum(CAST(p.w[i] AS BIGINT))::BIGINT AS s, count(*) AS n FROM a{r} a JOIN p USING (rid, part), (SELECT unnest(range(1, 17)) AS i) GROUP BY ALL) GROUP BY part, e),
b{n} AS (SELECT b.part, b.e, coalesce(m.w, b.w) AS w FROM b{r} b LEFT JOIN m{r} m ON m.part = b.part AND m.e = b.e)"""
OP11_SQL = f"""
WITH k AS (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT rid, part, v[16 * part + 1:16 * part + 16] AS w FROM k, (SELECT unnest(range(4)) AS part)),
f AS (SELECT rid, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k QUALIFY e < 256),
b0 AS (SELECT part, e, w FROM p JOIN f USING (rid)),
{",".join(OP11_ROUND.format(r=r) + "," + OP11_MEANS.format(r=r, n=r + 1) for r in range(4))},{OP11_ROUND.format(r=4)},
c AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a4 GROUP BY rid),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(w, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, e)) AS sha FROM b4)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM k JOIN c USING (rid), h
"""


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).drop("text")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = quality_flags(table(spark, sf_dir, "documents"))
    return filter_audit(with_labels(flags, table(spark, sf_dir, "labels")))


ORDERS = ", ".join(f"('{''.join(o)}')" for o in permutations("ABCDE"))
OP13_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS words FROM documents),
g AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
x AS (SELECT d.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  (CASE WHEN len(words) < 50 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END)
  || (CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) THEN 'C' ELSE '' END)
  || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END)
  || (CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END) AS failed
  FROM d LEFT JOIN g ON g.doc_id = d.doc_id),
o AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM (VALUES {ORDERS}) AS v(filter_order)),
f AS (SELECT part, failed, good, toxic, count(*) AS n FROM x GROUP BY ALL),
y AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, n, good, toxic, filter_order[step] AS own, contains(failed, filter_order[step]) AS fails, failed,
  len(list_filter(range(1, step), lambda k: contains(failed, filter_order[k]))) > 0 AS gone FROM f, o),
z AS (SELECT part, filter_order, step, any_value(own) AS own, sum(n) FILTER (WHERE NOT gone AND NOT fails) AS kept, sum(n) FILTER (WHERE fails AND NOT gone) AS removed,
  sum(n) FILTER (WHERE fails AND gone) AS redundant, sum(n) FILTER (WHERE failed = own) AS unique_fails,
  sum(n) FILTER (WHERE fails AND NOT gone AND good) AS good_lost, sum(n) FILTER (WHERE fails AND NOT gone AND toxic) AS toxic_lost FROM y GROUP BY part, filter_order, step)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley FROM z
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_mix_sources, op2_chat_format, op3_substring_dedup, op4_secret_scan, op5_line_dedup, op6_jaccard_join, op7_toxicity, op8_bm25_search, op9_bpe, op10_exact_dedup)
    return {f.__name__: f for f in (*made, op11_vector_codes, op12_quality, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    found = {"op2_chat_format": OP2_SQL, "op3_substring_dedup": OP3_SQL, "op6_jaccard_join": OP6_SQL, "op8_bm25_search": OP8_SQL, "op5_line_dedup": OP5_SQL, "op10_exact_dedup": OP10_SQL}
    return found | {"op11_vector_codes": OP11_SQL, "op13_filter_audit": OP13_SQL}
