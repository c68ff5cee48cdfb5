"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxaflow.llm import bpe, chaining, conversation_trie, crf, decontaminate, hmm, jaccard_join, line_dedup, quality_rules, resampling, simhash, spelling_variants, token_files
from taxaflow.llm.common import documents, held_out
from taxaflow.session import new_folder

Query = Callable[[SparkSession, str], DataFrame]


def op1_hmm(spark: SparkSession, folder: str) -> DataFrame:
    """Base and model score of every document; one of seven folds is held out."""
    return hmm.score_documents(documents(spark, folder).withColumn("held_out", held_out("doc_id", 7)))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Measures of every document and the verdict of the rules of its language and source."""
    return quality_rules.judge(documents(spark, folder))


def op5_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """Importance weight of every document, and whether it is drawn."""
    sampler, weights = resampling.fit(documents(spark, folder), documents(spark, folder, "labels"))
    return weights.select("doc_id", "log_weight", "key", sampler.drawn(F.col("key")).alias("kept"))


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items found in documents."""
    return decontaminate.leaks(documents(spark, folder), documents(spark, folder, "benchmark"))


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What repeated lines leave of every document."""
    lines = line_dedup.drop_lines(documents(spark, folder).select("doc_id", "text"))
    return lines.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2("lines.text", 256).alias("kept_sha256"))


def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Token files of every document, written, and read back."""
    files = new_folder(spark)
    token_files.write_ids(documents(spark, folder), files, public_tokenizers.path("word_bpe_49k.json"), 2)
    return token_files.read_ids(spark, files)


def op7_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Byte-level BPE ids of every document and their decoding, as digests."""
    return bpe.token_digests(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(documents(spark, folder), width=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_crf(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document; one of four folds is held out."""
    docs = documents(spark, folder).withColumn("held_out", held_out("doc_id", 4))
    model = spark.sparkContext.broadcast(crf.train(docs.where("not held_out")))
    predicted = docs.select("doc_id", "held_out", crf.predict(model, "text").alias("p"))
    return predicted.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op10_chaining(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that share fuzzy passages with others."""
    return chaining.repeated_passages(documents(spark, folder))


def op11_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Spelling variants of the words of all documents."""
    return spelling_variants.variants(documents(spark, folder))


def op12_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    return conversation_trie.prefix_trie(documents(spark, folder, "conversations"))


def op13_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Component of documents whose sets of word shingles are alike."""
    return jaccard_join.similar_sets(documents(spark, folder))


QUERIES: dict[str, Query] = {
    "op1_hmm": op1_hmm,
    "op2_quality_rules": op2_quality_rules,
    "op5_resampling": op5_resampling,
    "op3_decontamination": op3_decontamination,
    "op4_line_dedup": op4_line_dedup,
    "op6_token_files": op6_token_files,
    "op7_bpe": op7_bpe,
    "op8_simhash": op8_simhash,
    "op9_crf": op9_crf,
    "op10_chaining": op10_chaining,
    "op11_variants": op11_variants,
    "op12_trie": op12_trie,
    "op13_jaccard": op13_jaccard,
}

#: The unsigned CRC-32 of an expression's UTF-8 bytes, bit by bit; DuckDB has no function for it.
_CRC32 = (
    "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(octet_length(encode({0}))), lambda i: ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::BIGINT)), "
    "lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, _: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"
)

SQL: dict[str, str] = {
    "op4_line_dedup": """
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM split),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
hot AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.*, coalesce(k.doc_id < h.keeper, false) AS lost FROM keyed k LEFT JOIN hot h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op11_variants": f"""
WITH RECURSIVE lower AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(t, '[a-z\u00c0-\u00ff]+')) AS run FROM lower) GROUP BY ALL),
hashed AS (SELECT run, n, {_CRC32.format("(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)")} AS h FROM runs WHERE length(run) >= 6),
words AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n) AS n FROM hashed GROUP BY 1),
vocabulary AS (SELECT word, CAST(n AS BIGINT) AS n FROM words WHERE length(word) >= 6 AND n >= 5),
lost AS (SELECT DISTINCT word, n, left(word, i) || substr(word, i + 2) AS less, i FROM (SELECT *, unnest(range(length(word))) AS i FROM vocabulary)),
pairs AS (SELECT a.word, b.word AS other, b.n FROM lost a JOIN lost b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
          UNION SELECT a.word, v.word, v.n FROM lost a JOIN vocabulary v ON v.word = a.less
          UNION SELECT v.word, a.word, a.n FROM lost a JOIN vocabulary v ON v.word = a.less),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS m FROM pairs GROUP BY word),
found AS (SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 5 * v.n THEN b.other END AS form, CASE WHEN b.m >= 5 * v.n THEN b.m END AS form_n
          FROM vocabulary v LEFT JOIN best b USING (word)),
steps AS (SELECT word, word AS here, 0 AS i FROM found UNION ALL SELECT s.word, f.form, s.i + 1 FROM steps s JOIN found f ON f.word = s.here WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(here, i) AS root FROM steps GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM found JOIN ends USING (word)""",
    "op12_trie": f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS t FROM turns GROUP BY conv_id),
sized AS (SELECT conv_id, t, {_CRC32.format("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM own),
built AS (SELECT c.conv_id, list_concat(coalesce(b.t, [])[1:c.h], c.t[c.h + 1:]) AS t
          FROM sized c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5),
steps AS (SELECT conv_id, t, unnest(range(len(t) + 1)) AS depth FROM built),
members AS (SELECT conv_id, depth, len(t) = depth AS over, t[1:depth] AS path, t[depth].text AS last FROM steps),
nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN depth = 0 THEN 0 ELSE octet_length(encode(any_value(last))) END AS size,
                 sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE over), '')) AS ends_sha256
          FROM members GROUP BY path, depth),
kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
tree AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (path)),
above AS (SELECT path[1:up] AS path, n_children, (n_convs - 1) * size AS saved FROM (SELECT *, unnest(range(depth + 1)) AS up FROM tree)),
sums AS (SELECT path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM above GROUP BY path)
SELECT t.conv_id, t.depth, p.conv_id AS parent_conv_id, t.n_convs, t.n_children, s.n_leaves, s.saved_tokens, t.ends_sha256
FROM tree t JOIN sums s USING (path) LEFT JOIN tree p ON t.depth > 0 AND p.path = t.path[1:t.depth - 1]""",
    "op13_jaccard": """
WITH RECURSIVE lower AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
words AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM lower),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 5], ' ') AS s FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT DISTINCT a AS doc_id, a AS other FROM edges UNION SELECT r.doc_id, e.b FROM reached r JOIN edges e ON e.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least l USING (doc_id)""",
}
