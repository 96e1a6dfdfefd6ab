"""Queries that look at all documents together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.llm import jaccard, langid, lines, mixing, phrases, quality, sketches, substrings, tour
from gleaner.llm.queries.registry import query, table

# rows without an id are never learned from
HELD_OUT = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, true)"


@query("op2_quality_knn")
def op2_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.filter(f"not {HELD_OUT}"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", "predicted")


_SPACES = r"[ \t\r\f\x0B]+"

LINES_SQL = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), masked AS (
  SELECT doc_id, pos, list_filter(string_split_regex(regexp_replace(line, '[^ \t\r\f\x0B0-9]*[0-9][^ \t\r\f\x0B]*', '<*>', 'g'), '{_SPACES}'), lambda x: x <> '') AS words
  FROM lines
), keyed AS (
  SELECT doc_id, pos, words, len(words) || ' ' || array_to_string(words[1:{lines.DEPTH}], ' ') AS leaf, array_to_string(words, ' ') AS whole
  FROM masked WHERE len(words) > 0
), shared AS (
  SELECT leaf, count(DISTINCT whole) > 1 AS several FROM keyed GROUP BY leaf HAVING count(DISTINCT doc_id) >= {lines.MIN_DOCS}
), candidates AS (SELECT * FROM keyed JOIN shared USING (leaf)),
places AS (
  SELECT leaf, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM candidates WHERE several
), most AS (
  SELECT leaf, place, word, row_number() OVER (PARTITION BY leaf, place ORDER BY count(*) DESC, word) AS r
  FROM places GROUP BY leaf, place, word
), modes AS (SELECT leaf, list(word ORDER BY place) AS modes FROM most WHERE r = 1 GROUP BY leaf),
found AS (
  SELECT doc_id, pos, leaf, words, several, CASE WHEN NOT several OR len(list_filter(list_zip(words, modes), lambda x: x[1] = x[2])) >= CAST({lines.SIMILAR} AS DOUBLE) * len(words)
    THEN leaf ELSE leaf || '/' || whole END AS template
  FROM candidates LEFT JOIN modes USING (leaf)
), recurs AS (
  SELECT template, min(doc_id) AS first FROM found GROUP BY template HAVING count(DISTINCT doc_id) >= {lines.MIN_DOCS}
), rest AS (
  SELECT doc_id, pos, leaf, words FROM found LEFT JOIN recurs USING (template) WHERE several AND first IS NULL
), words_of AS (
  SELECT * FROM (
    SELECT doc_id, pos, leaf, len(words) AS n, {lines.DEPTH} + len(list_filter(words[{lines.DEPTH} + 1:], lambda x: x = '<*>')) AS sure,
      unnest(words) AS word, generate_subscripts(words, 1) AS place FROM rest
  ) WHERE place > {lines.DEPTH} AND word <> '<*>'
), frequent AS (
  SELECT leaf, place, word, place || ':' || word AS fixed FROM words_of GROUP BY leaf, place, word HAVING count(*) >= {lines.MIN_DOCS}
), parts AS (
  SELECT doc_id, pos, leaf, coalesce(list(fixed ORDER BY place) FILTER (fixed IS NOT NULL), []) AS fixed, sure, n
  FROM words_of LEFT JOIN frequent USING (leaf, place, word) GROUP BY doc_id, pos, leaf, sure, n
), alike AS (
  SELECT *, leaf || '/' || array_to_string(fixed, ' ') AS part FROM parts WHERE sure + len(fixed) >= CAST({lines.SIMILAR} AS DOUBLE) * n
), part_recurs AS (
  SELECT part, min(doc_id) AS first FROM alike GROUP BY part HAVING count(DISTINCT doc_id) >= {lines.MIN_DOCS}
), fewer AS (
  SELECT doc_id, pos, leaf || '/' || array_to_string(list_concat(fixed[1:i - 1], fixed[i + 1:]), ' ') AS part,
    string_split(fixed[i], ':')[1]::INT AS place
  FROM (
    SELECT a.*, unnest(range(1, len(fixed) + 1)) AS i FROM alike a LEFT JOIN part_recurs USING (part)
    WHERE first IS NULL AND sure + len(fixed) - 1 >= CAST({lines.SIMILAR} AS DOUBLE) * n
  )
), joined_lines AS (
  SELECT doc_id, pos, first FROM fewer JOIN part_recurs USING (part)
), others AS (
  SELECT * FROM fewer WHERE (doc_id, pos) NOT IN (SELECT (doc_id, pos) FROM joined_lines)
), shared_parts AS (
  SELECT part, place, count(DISTINCT doc_id) AS docs FROM others GROUP BY part, place HAVING docs >= {lines.MIN_DOCS}
), picked AS (
  SELECT doc_id, pos, part, place FROM others JOIN shared_parts USING (part, place)
  QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY docs DESC, place) = 1
), picked_recurs AS (
  SELECT part, place, min(doc_id) AS first FROM picked GROUP BY part, place HAVING count(DISTINCT doc_id) >= {lines.MIN_DOCS}
), long_lines AS (
  SELECT doc_id, pos, array_to_string(words, ' ') AS whole
  FROM (SELECT doc_id, pos, list_filter(string_split_regex(line, '{_SPACES}'), lambda x: x <> '') AS words FROM lines)
  WHERE len(words) >= {lines.LONG_WORDS}
), long_recurs AS (
  SELECT whole, min(doc_id) AS first FROM long_lines GROUP BY whole HAVING count(DISTINCT doc_id) >= {lines.LONG_DOCS}
), dropped AS (
  SELECT doc_id, pos FROM found JOIN recurs USING (template) WHERE doc_id <> first
  UNION SELECT doc_id, pos FROM alike JOIN part_recurs USING (part) WHERE doc_id <> first
  UNION SELECT doc_id, pos FROM joined_lines WHERE doc_id <> first
  UNION SELECT doc_id, pos FROM picked JOIN picked_recurs USING (part, place) WHERE doc_id <> first
  UNION SELECT doc_id, pos FROM long_lines JOIN long_recurs USING (whole) WHERE doc_id <> first
),
gone AS (SELECT doc_id, list(pos) AS ats FROM dropped GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(ats), 0) AS BIGINT) AS n_dropped,
  md5(CASE WHEN ats IS NULL THEN text ELSE array_to_string([string_split(text, chr(10))[i] FOR i IN range(1, len(string_split(text, chr(10))) + 1) IF NOT list_contains(ats, i)], chr(10)) END) AS kept_md5
FROM documents d LEFT JOIN gone g ON d.doc_id = g.doc_id
"""


@query("op4_line_templates", LINES_SQL)
def op4_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_dropped", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


# Target weights of the mixing query: parameters, by level of the tree.
WEIGHTS = [
    ("domain", "d0", 50), ("domain", "d1", 30), ("domain", "d2", 20),
    ("lang", "en", 40), ("lang", "de", 25), ("lang", "fr", 20), ("lang", "es", 15),
    ("source", "src4", 0),
]
DOMAIN = "concat('d', coalesce(ascii(right(source, 1)) % 3, 0))"


def target_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WEIGHTS, "level string, name string, weight long")


def _level_sql(depth: int) -> str:
    level, parents = mixing.LEVELS[depth], mixing.LEVELS[:depth]
    path = ", ".join(mixing.LEVELS[: depth + 1])
    by = f"PARTITION BY {', '.join(parents)} " if parents else ""
    above = f"JOIN b{depth - 1} a USING ({', '.join(parents)})" if parents else "CROSS JOIN (SELECT n AS budget FROM total) a"
    return f"""
n{depth} AS (SELECT {path}, {level} AS name, sum(n_tokens) * 2 AS capacity FROM usable GROUP BY {path}),
w{depth} AS (
  SELECT n.*, a.budget AS above, coalesce(w.weight, {mixing.DEFAULT_WEIGHT}) AS weight
  FROM n{depth} n {above}
  LEFT JOIN weights w ON w.level = '{level}' AND w.name = n.{level}
  WHERE capacity > 0
), f{depth} AS (
  SELECT *, row_number() OVER o AS r,
    greatest(above - coalesce(sum(capacity) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)::HUGEINT AS remaining,
    (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS weights
  FROM w{depth} WINDOW o AS ({by}ORDER BY capacity::DOUBLE / weight, name)
), g{depth} AS (
  SELECT *, min(CASE WHEN capacity * weights > remaining * weight THEN r END) OVER ({by}) AS stop FROM f{depth}
), h{depth} AS (
  SELECT *, max(CASE WHEN r = stop THEN remaining END) OVER ({by}) AS rest, max(CASE WHEN r = stop THEN weights END) OVER ({by}) AS of FROM g{depth}
), b{depth} AS (
  SELECT {path}, (CASE WHEN stop IS NULL OR r < stop THEN capacity ELSE least(capacity, rest * weight // of) END)::BIGINT AS budget FROM h{depth}
)"""


_VALUES = ", ".join(f"('{a}', '{b}', {c})" for a, b, c in WEIGHTS)
MIXING_SQL = (
    rf"""
WITH weights(level, name, weight) AS (VALUES {_VALUES}),
docs AS (
  SELECT doc_id, md5(coalesce(text, '')) AS text_sum, 'd' || coalesce(ascii(right(source, 1)) % 3, 0) AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    coalesce(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')), 0)::BIGINT AS n_tokens
  FROM documents
), total AS (SELECT floor(sum(n_tokens) * 0.6::DOUBLE)::BIGINT AS n FROM docs),
usable AS (
  SELECT * FROM docs WHERE domain NOT IN (SELECT name FROM weights WHERE level = 'domain' AND weight <= 0)
    AND lang NOT IN (SELECT name FROM weights WHERE level = 'lang' AND weight <= 0)
    AND source NOT IN (SELECT name FROM weights WHERE level = 'source' AND weight <= 0)
),"""
    + ",".join(_level_sql(d) for d in range(3))
    + """,
turns AS (
  SELECT *, md5('mix/' || epoch || '/' || coalesce(doc_id::VARCHAR, '')) AS digest
  FROM usable JOIN b2 USING (domain, lang, source), (SELECT unnest([0, 1]) AS epoch)
), summed AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY epoch, digest, text_sum RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM turns
)
SELECT doc_id, epoch::INTEGER AS epoch, n_tokens, domain, lang, source FROM summed WHERE upto <= budget
"""
)


@query("op9_mixture", MIXING_SQL)
def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = mixing.mix(table(spark, sf_dir, "documents"), target_weights(spark), F.expr(DOMAIN), epochs=2)
    return chosen.select(F.col("_id").alias("doc_id"), "epoch", "n_tokens", *mixing.LEVELS)


@query("op10_ngram_jaccard")
def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(table(spark, sf_dir, "documents"))


@query("op5_language")
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(f"not {HELD_OUT}"))
    return langid.predict(docs, model).select("doc_id", F.expr(HELD_OUT).alias("held_out"), "lang_pred", "score")


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"))


PHRASES_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, '{phrases.UNKNOWN}') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), split AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS words FROM pieces
), grams AS (
  SELECT lang, k, unnest([words[i : i + k - 1] FOR i IN range(1, len(words) - k + 2)]) AS gram
  FROM split, (SELECT unnest([1, 2, 3]) AS k)
), counted AS (SELECT lang, k, gram, count(*)::HUGEINT AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM counted WHERE k = 1 GROUP BY lang),
frequent AS (SELECT lang, k, gram, array_to_string(gram, ' ') AS phrase, f FROM counted WHERE f >= {phrases.LEAST}),
halves AS (
  SELECT lang, gram, phrase, f AS a, cut, array_to_string(gram[1:cut], ' ') AS head, array_to_string(gram[cut + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM frequent)
), cuts AS (
  SELECT h.*, x.f AS l, y.f AS r, 1000000 * a * a // (x.f * y.f) AS score
  FROM halves h JOIN frequent x ON x.lang = h.lang AND x.phrase = h.head JOIN frequent y ON y.lang = h.lang AND y.phrase = h.tail
), lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_pairs AS (
  SELECT lang, unnest([array_to_string(gram[1:2], ' '), array_to_string(gram[2:3], ' ')]) AS phrase, f FROM frequent WHERE k = 3
), longer AS (SELECT lang, phrase, max(f) AS f FROM inner_pairs GROUP BY lang, phrase),
ranked AS (
  SELECT c.lang, c.phrase, a, l, r, score,
    row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, c.phrase) AS rank
  FROM lowest c LEFT JOIN longer i ON i.lang = c.lang AND i.phrase = c.phrase
  WHERE i.f IS NULL OR 100 * i.f < {phrases.COVERED} * a
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= {phrases.TOP}
"""


@query("op13_phrases", PHRASES_SQL)
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query("op12_sketches")
def op12_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.digests(table(spark, sf_dir, "documents"))


# crc32 of the ASCII characters of x, bit by bit
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(x, ''), lambda c: ascii(c)::BIGINT)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda v, none: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT)"""

TOUR_SQL = rf"""
WITH turns AS (
  SELECT conv_id, md5(coalesce(role, '')) || md5(coalesce(text, '')) AS said, strlen(coalesce(text, ''))::BIGINT AS bytes,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, {_CRC.replace("string_split(x, '')", "string_split(conv_id::VARCHAR, '')")} % {tour.MOST_SHARED} AS h FROM turns GROUP BY conv_id
), joined AS (
  SELECT c.conv_id, 0 AS part, place, said, bytes FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % {tour.GROUP} AND t.place <= c.h
  UNION ALL
  SELECT c.conv_id, 1 AS part, place, said, bytes FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place > c.h
), paths AS (
  SELECT conv_id, row_number() OVER o AS depth, bytes, md5(string_agg(said, '') OVER o) AS path
  FROM joined WINDOW o AS (PARTITION BY conv_id ORDER BY part, place)
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), nodes AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes FROM paths GROUP BY depth, path
), up AS (
  SELECT DISTINCT p.depth, p.path, a.path AS parent FROM paths p JOIN paths a ON a.conv_id = p.conv_id AND a.depth = p.depth - 1
), sizes AS (
  SELECT n.*, up.parent, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN up USING (depth, path)
  LEFT JOIN (SELECT depth - 1 AS depth, parent AS path, count(*) AS n FROM up GROUP BY ALL) k USING (depth, path)
), above AS (
  SELECT DISTINCT a.depth, a.path, p.depth AS d, p.path AS p FROM paths a JOIN paths p ON a.conv_id = p.conv_id AND p.depth >= a.depth
), sums AS (
  SELECT above.depth, above.path, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * bytes) AS saved_tokens
  FROM above JOIN sizes s ON s.depth = d AND s.path = p GROUP BY ALL
), ends AS (
  SELECT depth, path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM (SELECT * FROM paths QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) = 1) GROUP BY depth, path
)
SELECT n.conv_id, depth, p.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens,
  sha256(coalesce(ids, '')) AS ends_sha256
FROM sizes n JOIN sums USING (depth, path) LEFT JOIN ends USING (depth, path)
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.parent
"""


@query("op11_prefix_trie", TOUR_SQL)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tour.prefix_trie(table(spark, sf_dir, "conversations"))
