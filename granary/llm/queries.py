"""The queries of the numbered operators: each applies its operator to a whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import bpe, chat, dac, exact_dedup, katz_lm, lang_id, near_vectors, ngram_join, packing, phrases, pieces, quality_crf, spelling
from granary.session import dealt, prepare, shared_folder, table


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file, installed with the workers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(id_col: str, n: int):
    """crc32 of the id as text, mod n."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def held(id_col: str, n: int):
    """Whether a document is held out: the fold 2. A null id isn't."""
    return F.coalesce(fold(id_col, n) == 2, F.lit(False))


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(prepare(spark), sf_dir, "embeddings"), threshold=0.93)


OP1_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM link l WHERE l.a = e.vec_id) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN comp ON comp.a = e.vec_id
"""


def op2_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as directly addressable codes, read back from the file."""
    path = shared_folder(prepare(spark))
    dac.write(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"), end_id=2)
    docs = dac.read(spark, path).select("part", "seq", "at", "doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return docs.join(dac.bases(spark, path), ["part", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(prepare(spark), sf_dir, "documents"), n=3, num=90, den=100)


def op4_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    file, pattern = vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.encode(dealt(table(prepare(spark), sf_dir, "documents")), file, pattern)
    return bpe.decode(coded, file, pattern).select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that holds the template's own control strings."""
    said = table(prepare(spark), sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trick = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text")
    )
    made = chat.formatted(chat.threads(said.unionByName(trick)))
    turns, learnt = chat.turns_of(F.col("formatted")), chat.masked(F.col("formatted"), F.col("loss"))
    read = made.select("conv_id", turns.alias("turns"), learnt.alias("learnt"), F.length("formatted").cast("long").alias("formatted_chars"))
    listing = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(listing, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars",
    )


OP5_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
esc AS (
  SELECT *, length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '#', '')) AS body FROM rows_)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + length(role) + 2 + body + 8) AS BIGINT) AS formatted_chars
FROM esc GROUP BY conv_id
"""


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(dealt(table(prepare(spark), sf_dir, "documents")), vocabulary("byte_bpe_50k.json"), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_size", "step_group")


def op7_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_lm.katz(table(prepare(spark), sf_dir, "documents"), held("doc_id", 7))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(table(prepare(spark), sf_dir, "documents"))
    model = lang_id.fit(docs.filter(~held("doc_id", 4)))
    found = lang_id.predict(docs, model)
    return found.select("doc_id", held("doc_id", 4).alias("held_out"), "lang_pred", "score")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the rows, by a hash of the id, are the snapshot and the rest are the new batch."""
    docs = table(prepare(spark), sf_dir, "documents")
    found = exact_dedup.exact_dedup(docs, F.xxhash64("doc_id") % 2 == 0)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


#: From this score on a document is predicted good.
GOOD = 0.7


def op10_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = dealt(table(prepare(spark), sf_dir, "documents")), table(spark, sf_dir, "labels")
    found = quality_crf.score(docs, quality_crf.fit(docs, labels.filter(~held("doc_id", 4))))
    return found.select("doc_id", held("doc_id", 4).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


OP9_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256, length(coalesce(text, '')) AS n
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


def op11_piece_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = vocabulary("piece_bpe_32k.model")
    coded = pieces.decode(pieces.encode(dealt(table(prepare(spark), sf_dir, "documents")), file), file)
    listing = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listing, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrases.phrases(dealt(table(prepare(spark), sf_dir, "documents")), least=100, longest=5, share=100)
    return phrases.best(found, 2000).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[\x20\x09]'), lambda x: x <> '') AS w FROM d),
q AS (SELECT lang, w FROM p WHERE len(w) > 0),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM q GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM q, range(1, 6) t(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
held AS (
  SELECT lang, array_to_string(w[1:k - 1], ' ') AS phrase, a FROM c WHERE k > 2
  UNION ALL SELECT lang, array_to_string(w[2:k], ' '), a FROM c WHERE k > 2),
dropped AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN held i ON i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.a >= 100 * c.a),
cuts AS (
  SELECT c.*, j, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1:k], ' ') AS y
  FROM c ANTI JOIN dropped d ON c.lang = d.lang AND c.phrase = d.phrase, range(1, 5) t(j) WHERE j < k),
s AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, x.a AS l, y.a AS r, n, j, CAST((1000::HUGEINT * cuts.a * n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = cuts.x JOIN f y ON y.lang = cuts.lang AND y.phrase = cuts.y JOIN total ON total.lang = cuts.lang),
lowest AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest QUALIFY rank <= 2000
"""


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.variants(dealt(table(prepare(spark), sf_dir, "documents")), every=199, shortest=6, least=5, ratio=5)
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_near_vectors": op1_near_vectors,
    "op2_token_codes": op2_token_codes,
    "op3_ngram_join": op3_ngram_join,
    "op4_bpe_roundtrip": op4_bpe_roundtrip,
    "op5_chat_format": op5_chat_format,
    "op6_packing": op6_packing,
    "op7_katz_lm": op7_katz_lm,
    "op8_language_id": op8_language_id,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_quality_crf": op10_quality_crf,
    "op11_piece_roundtrip": op11_piece_roundtrip,
    "op12_phrases": op12_phrases,
    "op13_spelling": op13_spelling,
    "pipeline": pipeline,
}
ORACLE_SQL = {"op1_near_vectors": OP1_SQL, "op5_chat_format": OP5_SQL, "op9_exact_dedup": OP9_SQL, "op12_phrases": OP12_SQL}
