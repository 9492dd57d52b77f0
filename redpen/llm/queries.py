"""The registered queries of this subpackage: name -> (Spark function, SQL for the check or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from redpen.llm import chat, convtrie, mixing, multiindex, neardup, packing, pieces, pii, quality, suffixtree, tokens, topk, vectorgraph


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_odd_sketch_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf, "documents"), "doc_id", "text")


OP1_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS shingles FROM split),
members AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n_a, any_value(b.n) AS n_b, count(*) AS n
  FROM members a JOIN members b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM common WHERE 100 * n >= 75 * (n_a + n_b - n)),
pairs AS (SELECT a AS i, b AS j FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS i, doc_id AS j FROM sets UNION SELECT reach.i, pairs.j FROM reach JOIN pairs ON pairs.i = reach.j)
SELECT s.doc_id, len(shingles)::BIGINT AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept
FROM sets s JOIN (SELECT i, min(j) AS component_id FROM reach GROUP BY i) m ON m.i = s.doc_id"""


def op2_kneser_ney_quality(spark: SparkSession, sf: str) -> DataFrame:
    trusted = quality.trusted_labels(table(spark, sf, "labels"))
    return quality.classify(table(spark, sf, "documents"), trusted, "doc_id", "text", "lang")


# target weights of the domains in op3
SHARES = {"clean": 0.9, "toxic": 0.04, "poor": 0.06}


def op3_soft_mixing(spark: SparkSession, sf: str) -> DataFrame:
    labelled = mixing.quality_domains(table(spark, sf, "labels"))
    rated = mixing.mix_sources(table(spark, sf, "documents"), labelled, "doc_id", "text", "domain", SHARES, ("source",))
    return rated.drop("text_hash")


def op4_pii_deobfuscation(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf, "documents"), "doc_id", "text")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    base = F.filter("personal", lambda x: x["base"])
    counts = [F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("personal")).alias("spans")
    )


def op5_rans_tokens(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    out = tokens.token_file_path(spark)
    tokens.write_tokens(table(spark, sf, "documents"), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"), out)
    return tokens.read_tokens(spark, out, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_pruned_graph(spark: SparkSession, sf: str) -> DataFrame:
    return vectorgraph.near_vectors(table(spark, sf, "embeddings"), "vec_id", "embedding")


OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
unit AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
links AS (
  SELECT a.vec_id AS i, b.vec_id AS j FROM unit a JOIN unit b ON a.vec_id <> b.vec_id AND a.norm > 0 AND b.norm > 0
  WHERE list_sum(list_transform(range(1, len(a.e) + 1), lambda k: a.e[k] * b.e[k])) / (a.norm * b.norm) >= 0.95),
reach AS (SELECT vec_id AS i, vec_id AS j FROM embeddings UNION SELECT reach.i, links.j FROM reach JOIN links ON links.i = reach.j)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM (SELECT i AS vec_id, min(j) AS component_id FROM reach GROUP BY i) LEFT JOIN (SELECT i AS vec_id, count(*) AS n FROM links GROUP BY i) USING (vec_id)"""


def op7_unigram_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Ids and log score of every document, and whether decoding gives the text back."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    vocabulary = pieces.Vocabulary.load(path)
    found = pieces.with_pieces(table(spark, sf, "documents").select("doc_id", "text"), "text", vocabulary)
    decoded = found.select("*", pieces.decode_column(F.col("ids"), vocabulary).alias("decoded"))
    plain = F.coalesce(F.translate("text", pieces.MARKER, " "), F.lit(""))
    return decoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), "score", (F.col("decoded") == plain).alias("round_trip"))


def op8_suffix_tree(spark: SparkSession, sf: str) -> DataFrame:
    return suffixtree.score_documents(table(spark, sf, "documents"), "doc_id", "text")


def op9_quotation_linking(spark: SparkSession, sf: str) -> DataFrame:
    """All conversations as mail with nested quotes; the operator has to find replies and bodies again."""
    rows = chat.reply_ordered(chat.mail_view(table(spark, sf, "conversations")))
    one = rows.select("conv_id", "thread", "segment", F.explode("messages").alias("m"))
    return one.select("conv_id", "m.turn", "m.role", "m.body", "m.reply_to", "thread", "m.depth", "m.quoted", "segment")


# the answer comes from the table itself: no quote is parsed
OP9_SQL = """
WITH RECURSIVE own AS (
  SELECT *, CASE WHEN turn % 4 = 3 THEN turn - 2 WHEN turn > 0 THEN turn - 1 END AS answers FROM conversations),
said AS (
  SELECT conv_id, turn, trim(regexp_replace(lower(line), '\\s+', ' ', 'g')) AS passage
  FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations)),
firsts AS (SELECT conv_id, passage, min(turn) AS original FROM said WHERE passage <> '' GROUP BY ALL),
votes AS (
  SELECT o.conv_id, o.turn, f.original, count(*) AS n
  FROM own o JOIN said s ON s.conv_id = o.conv_id AND s.turn = o.answers
  JOIN firsts f ON f.conv_id = s.conv_id AND f.passage = s.passage AND f.original < o.turn GROUP BY ALL),
chosen AS (
  SELECT conv_id, turn, original, n FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, original DESC) AS r FROM votes) WHERE r = 1),
links AS (
  SELECT o.conv_id, o.turn, coalesce(c.original, b.turn) AS parent, coalesce(c.n, 0) AS quoted
  FROM own o LEFT JOIN chosen c ON c.conv_id = o.conv_id AND c.turn = o.turn
  LEFT JOIN own b ON b.conv_id = o.conv_id AND b.turn = o.turn - 1),
tree AS (
  SELECT conv_id, turn, turn AS thread, 0::BIGINT AS depth FROM links WHERE parent IS NULL
  UNION ALL SELECT l.conv_id, l.turn, t.thread, t.depth + 1 FROM links l JOIN tree t ON t.conv_id = l.conv_id AND l.parent = t.turn)
SELECT o.conv_id, o.turn, o.role, o.text AS body, l.parent AS reply_to, t.thread, t.depth, l.quoted::BIGINT AS quoted,
       floor(o.turn / 64.0)::BIGINT AS segment
FROM own o JOIN links l ON l.conv_id = o.conv_id AND l.turn = o.turn JOIN tree t ON t.conv_id = o.conv_id AND t.turn = o.turn"""


def op10_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return topk.top_k(vectors, "vec_id", "embedding", F.col("vec_id") % 100 == 0)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 10"""



def op11_sum_of_squares_packing(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    packed = packing.pack_documents(table(spark, sf, "documents"), "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def rebuilt(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(turns, conversation ids): conversations that begin with up to eight turns of the next smaller multiple of five."""
    turns = convtrie.numbered(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")
    borrowed = F.crc32(F.col("conv").cast("string")) % 9
    ids = turns.select("conv").distinct()
    own = turns.filter(F.col("pos") > borrowed).withColumn("part", F.lit(1))
    firsts = turns.filter("pos <= 8 and conv % 5 = 0").withColumnRenamed("conv", "base")
    asked = ids.select("conv", (F.col("conv") - F.col("conv") % 5).alias("base"), borrowed.alias("borrowed")).filter("borrowed > 0")
    begun = asked.join(firsts, "base").filter("pos <= borrowed").select(*turns.columns, F.lit(0).alias("part"))
    return own.unionByName(begun), ids


def op12_conversation_trie(spark: SparkSession, sf: str) -> DataFrame:
    turns, ids = rebuilt(spark, sf)
    return convtrie.prefix_trie(turns, "conv", ["part", "pos"], "role", "text", ids).withColumnRenamed("saved_bytes", "saved_tokens")


OP12_SQL = """
WITH RECURSIVE turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
         {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id, xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
    lambda acc, byte: list_reduce(list_concat([xor(acc, byte)], range(8)), lambda crc, bit: CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END)),
    4294967295) % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
parts AS (
  SELECT i.conv_id, 0 AS part, pos, said FROM ids i JOIN turns t ON t.conv_id = i.conv_id - i.conv_id % 5 AND pos <= h
  UNION ALL SELECT i.conv_id, 1, pos, said FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND pos > h),
whole AS (
  SELECT conv_id, coalesce(list(said ORDER BY part, pos) FILTER (WHERE said IS NOT NULL), []) AS said FROM ids LEFT JOIN parts USING (conv_id) GROUP BY conv_id),
prefixes AS (SELECT conv_id, said, unnest(range(0, len(said) + 1)) AS depth FROM whole),
nodes AS (
  SELECT said[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CASE WHEN depth = len(said) THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM prefixes GROUP BY ALL),
children AS (SELECT path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
valued AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children, (n_convs - 1) * CASE WHEN depth = 0 THEN 0 ELSE octet_length(encode(path[depth].text)) END AS own
  FROM nodes n LEFT JOIN children c USING (path)),
subtrees AS (
  SELECT path[1:upto] AS path, sum((n_children = 0)::BIGINT) AS n_leaves, sum(own) AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS upto FROM valued) GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, n.n_children::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM valued n JOIN subtrees s ON s.path = n.path LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1]"""


def op13_multi_index_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """One row in seven gets the next label first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf, "embeddings").withColumn("label", label)
    return multiindex.mine(vectors, "vec_id", "label", "embedding", F.col("vec_id") % 50 == 0)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM scored WHERE same) WHERE r <= 5)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, positive_id, n.vec_id AS negative_id, positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score)
WHERE rank <= 3"""

QUERIES = {
    "op1_odd_sketch_dedup": (op1_odd_sketch_dedup, OP1_SQL),
    "op2_kneser_ney_quality": (op2_kneser_ney_quality, None),
    "op3_soft_mixing": (op3_soft_mixing, None),
    "op4_pii_deobfuscation": (op4_pii_deobfuscation, None),
    "op5_rans_tokens": (op5_rans_tokens, None),
    "op6_pruned_graph": (op6_pruned_graph, OP6_SQL),
    "op7_unigram_pieces": (op7_unigram_pieces, None),
    "op8_suffix_tree": (op8_suffix_tree, None),
    "op9_quotation_linking": (op9_quotation_linking, OP9_SQL),
    "op10_exact_topk": (op10_exact_topk, OP10_SQL),
    "op11_sum_of_squares_packing": (op11_sum_of_squares_packing, None),
    "op12_conversation_trie": (op12_conversation_trie, OP12_SQL),
    "op13_multi_index_negatives": (op13_multi_index_negatives, OP13_SQL),
}
