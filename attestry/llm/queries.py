"""The driver's queries on the operators of this subpackage, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import align, byte_bpe, common, exact_dedup, language, licences, nearest, packing, phrases, preferences, simhash, suffixes, tree_bpe, url_filter


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    read = common.ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return read.select(*columns) if columns else read


def tokenizer_file(name: str) -> str:
    """Where the box keeps a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 1024 tokens."""
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_file("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op3_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself with a swapped last answer; digests of what is rendered, and what the masks cover."""
    pairs = preferences.format_sides(preferences.swapped_answers(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")))
    covered = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])  # noqa: E731
    return pairs.select(
        "pair_id", "block", "prompt_turns", F.sha2("prompt", 256).alias("prompt_sha256"), F.sha2("chosen", 256).alias("chosen_sha256"), F.sha2("rejected", 256).alias("rejected_sha256"),
        covered(F.col("chosen_mask")).alias("chosen_masked"), covered(F.col("rejected_mask")).alias("rejected_masked"),
    )  # fmt: skip


OP3_SQL = """
WITH talk AS (
  SELECT DISTINCT conv_id AS pair_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
answers AS (SELECT pair_id, max(turn) AS last FROM talk WHERE role = 'assistant' GROUP BY pair_id),
closing AS (
  SELECT a.pair_id, a.last, max(t.text) AS text FROM answers a JOIN talk t ON t.pair_id = a.pair_id AND t.turn = a.last AND t.role = 'assistant'
  GROUP BY a.pair_id, a.last),
paired AS (
  SELECT DISTINCT t.*, CASE WHEN t.turn = a.last AND t.role = 'assistant' THEN o.text ELSE t.text END AS other
  FROM talk t JOIN closing a USING (pair_id) JOIN closing o ON o.pair_id = xor(t.pair_id, 1)),
said AS (SELECT pair_id, turn, role, text, 'c' AS side FROM paired UNION SELECT pair_id, turn, role, other, 'r' FROM paired),
at_turn AS (SELECT pair_id, turn, side, list({'role': role, 'text': text} ORDER BY role, text) AS said FROM said GROUP BY ALL),
split AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, count(*) AS n, min(CASE WHEN c.said IS DISTINCT FROM r.said THEN coalesce(c.turn, r.turn) END) AS split
  FROM (SELECT * FROM at_turn WHERE side = 'c') c FULL JOIN (SELECT * FROM at_turn WHERE side = 'r') r ON c.pair_id = r.pair_id AND c.turn = r.turn
  GROUP BY 1),
marked AS (
  SELECT pair_id, turn, role, text, CASE WHEN split IS NULL OR turn < split THEN 'p' ELSE side END AS part, side,
    '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered, CASE WHEN n <= 512 THEN 0 ELSE CAST(floor(greatest(turn, 0) / 512.0) AS BIGINT) END AS block
  FROM said JOIN split USING (pair_id)),
once AS (SELECT * FROM marked WHERE part <> 'p' OR side = 'c')
SELECT pair_id, block,
  CAST(count(DISTINCT CASE WHEN part = 'p' THEN turn END) AS BIGINT) AS prompt_turns,
  sha256(coalesce(string_agg(rendered, '' ORDER BY turn, role, text) FILTER (part = 'p'), '')) AS prompt_sha256,
  sha256(coalesce(string_agg(rendered, '' ORDER BY turn, role, text) FILTER (part = 'c'), '')) AS chosen_sha256,
  sha256(coalesce(string_agg(rendered, '' ORDER BY turn, role, text) FILTER (part = 'r'), '')) AS rejected_sha256,
  CAST(coalesce(sum(length(text) + 7) FILTER (part = 'c' AND role = 'assistant'), 0) AS BIGINT) AS chosen_masked,
  CAST(coalesce(sum(length(text) + 7) FILTER (part = 'r' AND role = 'assistant'), 0) AS BIGINT) AS rejected_masked
FROM once GROUP BY pair_id, block
"""


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's best licence notice, if any line, paragraph or the whole of it comes close to a template."""
    return licences.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def _licence_sql() -> str:
    rows = ", ".join("(%s, [%s], %d)" % (f"'{name}'", ", ".join(f"'{b}'" for b in grams), len(grams)) for name, grams, _ in licences.template_bigrams(licences.TEMPLATES))
    return rf"""
WITH templates(licence, b, n) AS (VALUES {rows}),
units AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS unit FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, unit FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '
[ 	

]*
')) AS unit FROM documents WHERE text LIKE '%' || chr(10) || '%') WHERE unit LIKE '%' || chr(10) || '%'
  UNION ALL SELECT doc_id, text FROM documents WHERE text LIKE '%' || chr(10) || chr(10) || '%'),
words AS (
  SELECT doc_id, string_split(trim(regexp_replace(lower(unit), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w, row_number() OVER () AS u FROM units),
bigrams AS (
  SELECT doc_id, u, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words WHERE len(w) >= 2),
scored AS (
  SELECT doc_id, u, licence, 2.0 * len(list_intersect(g, b)) / (len(g) + n) AS score FROM bigrams JOIN templates ON 5 * n >= 2 * len(g) AND 5 * len(g) >= 2 * n
  WHERE list_has_any(g, b)),
best AS (SELECT doc_id, u, max(score) AS score FROM scored WHERE score >= 0.8 GROUP BY doc_id, u),
named AS (SELECT s.doc_id, s.u, s.score, min(s.licence) AS licence FROM scored s JOIN best b ON s.u = b.u AND s.score = b.score GROUP BY ALL),
top AS (SELECT doc_id, max(score) AS score, count(*) AS n_units FROM named GROUP BY doc_id)
SELECT d.doc_id, min(n.licence) AS licence, CAST(t.score AS DOUBLE) AS score, CAST(coalesce(t.n_units, 0) AS INTEGER) AS n_units
FROM documents d LEFT JOIN top t ON d.doc_id = t.doc_id LEFT JOIN named n ON n.doc_id = t.doc_id AND n.score = t.score
GROUP BY d.doc_id, t.score, t.n_units
"""


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint over three-word shingles and its component at two bits or fewer."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), words=3, radius=2)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the two thirds that are not held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    predicted = language.predict(docs, language.fit(docs))
    return predicted.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, and what they decode to, as digests."""
    import public_tokenizers

    ranks = byte_bpe.read_ranks(tokenizer_file("byte_bpe_50k.tiktoken"))
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents", "doc_id", "text"), ranks, public_tokenizers.PATTERN)
    ids = F.sha2(F.array_join("ids", " "), 256)
    return byte_bpe.decode(encoded, ranks).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the bytes of repeated 400-byte strings; and whether a passage of over 50 words, which may be shorter, repeats."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    left = common.stage(suffixes.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")))
    repeats = suffixes.with_passages(docs).withColumn("repeats", F.lit(True))
    return left.join(repeats, "doc_id", "left").withColumn("repeats", F.coalesce("repeats", F.lit(False)))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest found of every hundredth vector, among all others."""
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return nearest.search(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


#: The rules of op10, as (host, path, verdict).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of pages against the four fixed rules."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages", "page_id", "url"), rules)


OP10_SQL = r"""
WITH parts AS (
  SELECT page_id,
    coalesce(CASE WHEN instr(url, '://') > 0 THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END, '') AS host,
    coalesce(CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) END, '') AS path
  FROM pages),
fits AS (
  SELECT *, (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') AS r1,
    (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') AS r2,
    (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') AS r3,
    (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') AS r4
  FROM parts)
SELECT page_id, host, path,
  CASE WHEN r2 THEN 'example.net/en/' WHEN r3 THEN 'example.com/de/' WHEN r4 THEN 'org/fr/' WHEN r1 THEN 'net/' END AS rule,
  CASE WHEN r2 THEN 'allow' WHEN r3 THEN 'block' WHEN r4 THEN 'allow' WHEN r1 THEN 'block' ELSE 'allow' END AS verdict
FROM fits
"""


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the document that stays in its place."""
    return exact_dedup.duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


OP2_SQL = r"""
WITH hashed AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, CAST(count(*) OVER same AS BIGINT) AS group_size,
  doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM hashed WINDOW same AS (PARTITION BY text_sha256)
"""


def op11_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids by the segment tree, and what they decode to, as digests."""
    path = tokenizer_file("word_bpe_49k.json")
    decoded = tree_bpe.decode(tree_bpe.encode(table(spark, sf_dir, "documents", "doc_id", "text"), path), path)
    n = (F.octet_length("ids") / 4).cast("long")
    return decoded.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's groups of tokens of two tokenizers, and how common its links are in the corpus."""
    aligned = align.align(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2(F.encode("groups", "UTF-8"), 256))
    return aligned.select("doc_id", *align.NUMBERS, digest.alias("groups_sha256"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 phrases of each language that hang together most."""
    return phrases.mine(table(spark, sf_dir, "documents", "text", "lang"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS p, piece FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]')) AS piece FROM documents)),
said AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda x: x <> '') AS w FROM pieces),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM said GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM said, (SELECT unnest(range(1, 5)) AS k) WHERE len(w) >= k)),
known AS (SELECT lang, phrase, min(k) AS k, count(*) AS f FROM grams GROUP BY lang, phrase HAVING count(*) >= 30),
cuts AS (
  SELECT lang, phrase, k, f AS a, c, array_to_string(string_split(phrase, ' ')[1:c], ' ') AS part, array_to_string(string_split(phrase, ' ')[c + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS c FROM known WHERE k > 1)),
scored AS (
  SELECT c.lang, c.phrase, c.k, c.a, c.c, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
  FROM cuts c JOIN known x ON x.lang = c.lang AND x.phrase = c.part JOIN known y ON y.lang = c.lang AND y.phrase = c.rest),
candidates AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
around AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[i:i + m - 1], ' ') AS phrase, max(a) AS longest
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM candidates WHERE k > 2)) GROUP BY ALL),
kept AS (SELECT c.* FROM candidates c LEFT JOIN around o ON o.lang = c.lang AND o.phrase = c.phrase WHERE o.longest IS NULL OR CAST(100 AS HUGEINT) * o.longest < CAST(80 AS HUGEINT) * c.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "pipeline": pipeline,
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_preferences": op3_preferences,
        "op4_simhash": op4_simhash,
        "op5_licences": op5_licences,
        "op6_language": op6_language,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_nearest": op9_nearest,
        "op10_url_filter": op10_url_filter,
        "op11_tree_bpe": op11_tree_bpe,
        "op12_align": op12_align,
        "op13_phrases": op13_phrases,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": OP2_SQL,
        "op3_preferences": OP3_SQL,
        "op5_licences": _licence_sql(),
        "op10_url_filter": OP10_SQL,
        "op13_phrases": OP13_SQL,
    }
