"""Queries of recognition: scripts, letter pairs, nearest neighbours, regions, vocabularies, digests, glyphs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scripts
from ..operators import neighbours, regions, spelling
from ..operators.extract import extract
from ..operators.ocr import engine, glyphs, language
from ..operators.schema import get
from ..sources.packages import made, pdf_of_pixels, png_of_pixels
from .detection_queries import table


def script_histogram(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(scripts.histogram(F.col("text"))).alias("x")).select("doc_id", "x.script", "x.n")


def dominant_script(spark, sf):
    return table(spark, sf, "documents").select("doc_id", scripts.dominant(F.col("text")).alias("script"))


def bigram_table(spark, sf):
    rows = spark.createDataFrame([(p[0], p[1], float(n)) for p, n in language.PAIRS], "before string, after string, n double")
    total = F.sum("n").over(Window.partitionBy("before"))
    return rows.select("before", "after", F.round(F.ln((F.col("n") + language.SMOOTH) / (total + language.SMOOTH * language.SYMBOLS)), 9).alias("log_p"))


def bigram_score(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(scripts.pair_score(F.col("text")), 6).alias("score"))


def _found(spark, sf, k: int = 5):
    vectors = table(spark, sf, "embeddings")
    return neighbours.exact(vectors, vectors.where("vec_id % 20 = 0"), k)


def knn_topk(spark, sf):
    """The five nearest other vectors of every twentieth one."""
    return _found(spark, sf).select("query_id", "vec_id", "label", "rank", F.round("distance", 6).alias("distance"))


def knn_vote(spark, sf):
    """The label that these five give by weight."""
    return neighbours.vote(_found(spark, sf), key="query_id").select("query_id", "label", F.round("confidence", 6).alias("confidence"))


def prototype_topk(spark, sf):
    """The three nearest label means of every vector."""
    return neighbours.nearest(table(spark, sf, "embeddings"), neighbours.label_means(table(spark, sf, "embeddings")), 3).select("vec_id", "label", "rank", F.round("distance", 6).alias("distance"))


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """(image, id, x, y, w, h): an order is an image, its lines are regions."""
    c = lambda name: F.col(name).cast("long")
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).cast("long")
    return table(spark, sf, "lineitem").select(c("l_orderkey").alias("image"), number.alias("id"), (c("l_partkey") % 40).alias("x"), (c("l_suppkey") % 20).alias("y"), (5 + c("l_quantity") % 20).alias("w"), (4 + c("l_linenumber") * 3 % 9).alias("h"))


def iou_pairs(spark, sf):
    return regions.overlaps(boxes(spark, sf)).select("image", "a", "b", F.round("iou", 9).alias("iou"))


def nms(spark, sf):
    return regions.suppressed(boxes(spark, sf), 0.3)


def region_filter(spark, sf):
    return regions.plausible(boxes(spark, sf), 0.5, 4.0, 5, 11, 40).select("image", "id")


def neighbor_density(spark, sf):
    return regions.neighbour_counts(boxes(spark, sf))


def region_lines(spark, sf):
    return regions.line_numbers(boxes(spark, sf))


def line_gaps(spark, sf):
    """Gaps between regions in order of x, an image as one line."""
    return regions.gaps(boxes(spark, sf).withColumn("line", F.lit(0)))


def stability_window(spark, sf):
    """Relative change from the event before to the one behind, by user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    change = (F.lead("value").over(w) - F.lag("value").over(w)) / F.nullif(F.col("value"), F.lit(0.0))
    return table(spark, sf, "events").select("event_id", F.round(change, 6).alias("change"))


def cv_filter(spark, sf):
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), (F.stddev_pop("value") / F.avg("value")).alias("cv"))
    return rows.where("cv <= 1.0").select("user_id", "n", F.round("cv", 6).alias("cv"))


def content_dedup(spark, sf):
    rows = table(spark, sf, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    return rows.agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


def _words(spark, sf, name="benchmark") -> DataFrame:
    return table(spark, sf, name).select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("word <> ''")


def spell_lookup(spark, sf):
    """Words of the test items that aren't in the vocabulary, which is the words seen three times or more, and the nearest one that is."""
    counted = _words(spark, sf).groupBy("word").agg(F.count("*").alias("n"))
    return spelling.corrections(counted.where("n < 3").select("word"), counted.where("n >= 3").select("word", "n"))


def spell_text(spark, sf):
    """First turns of conversations, each word that isn't in the vocabulary of the test items replaced by the nearest one that is."""
    counted = _words(spark, sf).groupBy("word").agg(F.count("*").alias("n"))
    rows = table(spark, sf, "conversations").where("turn = 0").select("conv_id", "text")
    return spelling.corrected(rows, "conv_id", "text", counted.where("n >= 3"))


def dict_bonus(spark, sf):
    words = _words(spark, sf, "conversations").distinct()
    return spelling.bonus(words, _words(spark, sf).distinct())


def viterbi(spark, sf):
    """The whole text of each test item from candidates: each letter itself and the next one, which is farther."""

    @F.pandas_udf("string")
    def best(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: language.viterbi([[(c, 0.1), (chr(ord(c) + 1), 0.3)] for c in t]), na_action="ignore")

    return table(spark, sf, "benchmark").select("item_id", best("text").alias("text"))


def beam(spark, sf):
    """As viterbi, with all words of all test items as the vocabulary."""
    items = table(spark, sf, "benchmark")
    known = language.collected(items.select(F.explode(F.split("text", r"\s+")).alias("word")))
    sent = spark.sparkContext.broadcast(known)

    @F.pandas_udf("string")
    def best(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: language.beam([[(c, 0.1), (chr(ord(c) + 1), 0.15)] for c in t], sent.value), na_action="ignore")

    return items.select("item_id", best("text").alias("text"))


def k_medoids(spark, sf):
    return neighbours.label_medoids(table(spark, sf, "embeddings"), 4)


def k_means(spark, sf):
    return neighbours.means(table(spark, sf, "embeddings"), 8, 10)


def feature_vector(spark, sf):
    rows = [(g, k, glyphs.features(glyphs.bitmap(g, k)).tolist()) for g in glyphs.GLYPHS for k in (3, 4)]
    return spark.createDataFrame(rows, "label string, scale int, features array<double>")


def ocr_names(spark, sf):
    """Names of nations, drawn as images and read back."""
    images = table(spark, sf, "nation").select("n_nationkey", made(lambda n: engine.pgm(glyphs.rendered(n)), F.col("n_name")).alias("image"))
    return engine.read_images(images, "image").select("n_nationkey", F.col("ocr.text").alias("text"), F.col("ocr.status").alias("status"), F.element_at(engine.as_metadata(F.col("ocr")), "ocr_applied").alias("applied"))


def _drawn(spark, sf, build) -> DataFrame:
    return table(spark, sf, "nation").select("n_nationkey", made(lambda n: build(glyphs.rendered(n)), F.col("n_name")).alias("content"))


def _read(rows: DataFrame, mime: str) -> DataFrame:
    m = F.col("metadata")
    found = extract(rows.withColumn("hint", F.lit(mime)), "content", hint="hint", ocr=engine.configured({"siltstone.ocr": "classical"}.get))
    return found.select("n_nationkey", "text", get(m, "ocr_status").alias("status"), get(m, "ocr_applied", "boolean").alias("applied"), (get(m, "ocr_confidence", "float") > 0.5).alias("sure"))


def ocr_png(spark, sf):
    """Names of nations drawn as PNG files and read by the image parser."""
    return _read(_drawn(spark, sf, png_of_pixels), "image/png")


def ocr_pdf(spark, sf):
    """The same as images in PDF files without text."""
    return _read(_drawn(spark, sf, pdf_of_pixels), "application/pdf")


QUERIES = {
    f.__name__: f
    for f in (
        script_histogram, dominant_script, bigram_table, bigram_score, knn_topk, knn_vote, prototype_topk, iou_pairs, nms, region_filter, neighbor_density, region_lines, line_gaps, stability_window, cv_filter,
        content_dedup, spell_lookup, spell_text, dict_bonus, viterbi, beam, k_medoids, k_means, feature_vector, ocr_names, ocr_png, ocr_pdf,
    )
}

_VALUES = ", ".join(f"('{p[0]}', '{p[1]}', CAST({n} AS DOUBLE))" for p, n in language.PAIRS)
_LOGS = f"(SELECT before, after, ln((n + {language.SMOOTH}) / (sum(n) OVER (PARTITION BY before) + {language.SMOOTH * language.SYMBOLS})) AS log_p FROM (VALUES {_VALUES}) v(before, after, n))"
_COUNTS = ", ".join(f"CAST(len(regexp_extract_all(text, '[{scripts.sql_class(s)}]')) AS BIGINT) AS {s}" for s in scripts.CLASSES)
_SEEN = f"(SELECT doc_id, {_COUNTS}, CAST(length(regexp_replace(text, '[{scripts.SQL_SPACE}]', '', 'g')) AS BIGINT) AS total FROM documents)"
_LONG = " UNION ALL ".join(f"SELECT doc_id, '{s}' AS script, {k} AS place, {s} AS n FROM s" for k, s in enumerate(scripts.CLASSES)) + f" UNION ALL SELECT doc_id, 'Other', 99, total - ({' + '.join(scripts.CLASSES)}) FROM s"
_MEANS = "(SELECT label, list(m ORDER BY i) AS mean FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)"
_NEAR = f"(SELECT vec_id, m.label, list_distance(CAST(embedding AS DOUBLE[]), mean) AS d, row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(CAST(embedding AS DOUBLE[]), mean), m.label) AS rank FROM embeddings, {_MEANS} m QUALIFY rank <= 3)"
_KNN = "(SELECT q.vec_id AS query_id, r.vec_id, r.label, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])), r.vec_id) AS rank FROM embeddings q, embeddings r WHERE q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id QUALIFY rank <= 5)"
_BOX = "(SELECT l_orderkey AS image, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS id, l_partkey % 40 AS x, l_suppkey % 20 AS y, 5 + CAST(l_quantity AS BIGINT) % 20 AS w, CAST(4 + l_linenumber * 3 % 9 AS BIGINT) AS h FROM lineitem)"
_INTER = "greatest(0, least(p.x + p.w, q.x + q.w) - greatest(p.x, q.x)) * greatest(0, least(p.y + p.h, q.y + q.h) - greatest(p.y, q.y))"
_OVER = "CAST(greatest(0, least(p.x + p.w, {q}.x + {q}.w) - greatest(p.x, {q}.x)) * greatest(0, least(p.y + p.h, {q}.y + {q}.h) - greatest(p.y, {q}.y)) AS DOUBLE) / (p.w * p.h + {q}.w * {q}.h - greatest(0, least(p.x + p.w, {q}.x + {q}.w) - greatest(p.x, {q}.x)) * greatest(0, least(p.y + p.h, {q}.y + {q}.h) - greatest(p.y, {q}.y)))"
_JOINS = "list_transform(a, lambda s: greatest(0, least(c[1].high, s.high) - greatest(c[1].low, s.low)) >= 0.5 * least(greatest(1, c[1].high - c[1].low), greatest(1, s.high - s.low)))"
_LINE = f"a[list_position({_JOINS}, true)]"
_WORDS = lambda t: f"(SELECT word FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) AS word FROM {t}) WHERE word <> '')"

#: No SQL for spell_lookup: DuckDB's levenshtein counts bytes; it is tested against brute force.
ORACLE = {
    "script_histogram": f"WITH s AS {_SEEN}, l AS ({_LONG}) SELECT doc_id, script, n FROM l WHERE n > 0",
    "dominant_script": f"WITH s AS {_SEEN}, l AS ({_LONG}) SELECT d.doc_id, x.script FROM documents d LEFT JOIN (SELECT doc_id, script FROM l WHERE n > 0 AND script NOT IN ('Digit', 'Other') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, place) = 1) x ON x.doc_id = d.doc_id",
    "bigram_table": f"SELECT before, after, round(log_p, 9) AS log_p FROM {_LOGS}",
    "bigram_score": f"""WITH t AS (SELECT doc_id, lower(text) AS s FROM documents), p AS (SELECT doc_id, s, unnest(range(1, greatest(length(s), 1))) AS i FROM t),
      g AS (SELECT doc_id, substr(s, CAST(i AS BIGINT), 1) AS a, substr(s, CAST(i AS BIGINT) + 1, 1) AS b, count(*) AS n FROM p GROUP BY ALL), x AS (SELECT doc_id, sum(n * coalesce(log_p, {language.FLOOR})) AS v FROM g LEFT JOIN {_LOGS} l ON l.before = a AND l.after = b GROUP BY doc_id)
      SELECT t.doc_id, CASE WHEN t.s IS NULL THEN NULL ELSE round(coalesce(v, 0) / greatest(length(s) - 1, 1), 6) END AS score FROM t LEFT JOIN x ON x.doc_id = t.doc_id""",
    "knn_topk": f"SELECT query_id, vec_id, label, rank, round(d, 6) AS distance FROM {_KNN}",
    "knn_vote": f"SELECT query_id, label, round(exp(-best), 6) AS confidence FROM (SELECT query_id, label, sum(1 / (d + 0.001)) AS v, min(min(d)) OVER (PARTITION BY query_id) AS best FROM {_KNN} GROUP BY query_id, label) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY v DESC, label) = 1",
    "prototype_topk": f"SELECT vec_id, label, rank, round(d, 6) AS distance FROM {_NEAR}",
    "iou_pairs": f"WITH b AS {_BOX}, x AS (SELECT p.image, p.id AS a, q.id AS b, {_INTER} AS n, p.w * p.h + q.w * q.h AS s FROM b p JOIN b q ON p.image = q.image AND p.id < q.id) SELECT image, a, b, round(CAST(n AS DOUBLE) / (s - n), 9) AS iou FROM x WHERE n > 0",
    "nms": f"""WITH b AS {_BOX}, g AS (SELECT image, list([{{'id': id, 'x': x, 'y': y, 'w': w, 'h': h}}] ORDER BY w * h DESC, id) AS l FROM b GROUP BY image),
      r AS (SELECT image, list_reduce(l, lambda a, c: CASE WHEN len(list_filter(a, lambda p: {_OVER.format(q='c[1]')} > 0.3)) = 0 THEN list_concat(a, c) ELSE a END) AS kept FROM g)
      SELECT image, unnest(list_transform(kept, lambda k: k.id)) AS id FROM r""",
    "region_lines": f"""WITH b AS (SELECT image, x, y, w, h, list(id ORDER BY id) AS ids FROM {_BOX} GROUP BY ALL),
      g AS (SELECT image, list([{{'low': y, 'high': y + h, 'ids': ids}}] ORDER BY y, x, ids[1]) AS l FROM b GROUP BY image),
      r AS (SELECT image, list_reduce(l, lambda a, c: CASE WHEN coalesce(list_position({_JOINS}, true), 0) = 0 THEN list_concat(a, c) ELSE list_concat(list_concat(a[:list_position({_JOINS}, true) - 1],
        [{{'low': least({_LINE}.low, c[1].low), 'high': greatest({_LINE}.high, c[1].high), 'ids': list_concat({_LINE}.ids, c[1].ids)}}]), a[list_position({_JOINS}, true) + 1:]) END) AS lines FROM g),
      n AS (SELECT image, unnest(lines) AS line, generate_subscripts(lines, 1) AS made FROM r), o AS (SELECT image, line.ids AS ids, row_number() OVER (PARTITION BY image ORDER BY line.low, made) - 1 AS line FROM n)
      SELECT image, unnest(ids) AS id, CAST(line AS INTEGER) AS line FROM o""",
    "region_filter": f"SELECT image, id FROM {_BOX} WHERE CAST(w AS DOUBLE) / h BETWEEN 0.5 AND 4.0 AND h BETWEEN 5 AND 11 AND w * h >= 40",
    "neighbor_density": f"WITH b AS {_BOX} SELECT p.image, p.id, count(q.id) AS neighbours FROM b p LEFT JOIN b q ON p.image = q.image AND p.id <> q.id AND abs((q.y + q.h * 0.5) - (p.y + p.h * 0.5)) <= 0.5 * p.h AND CAST(q.h AS DOUBLE) / p.h BETWEEN 0.5 AND 2.0 AND greatest(q.x - p.x - p.w, p.x - q.x - q.w, 0) <= 3.0 * p.h GROUP BY p.image, p.id",
    "line_gaps": f"SELECT image, 0 AS line, id, greatest(0, x - lag(x + w) OVER (PARTITION BY image ORDER BY x, id)) AS gap FROM {_BOX} QUALIFY lag(x + w) OVER (PARTITION BY image ORDER BY x, id) IS NOT NULL",
    "stability_window": "SELECT event_id, round((lead(value) OVER w - lag(value) OVER w) / nullif(value, 0), 6) AS change FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "cv_filter": "SELECT user_id, n, round(cv, 6) AS cv FROM (SELECT user_id, count(*) AS n, stddev_pop(value) / avg(value) AS cv FROM events GROUP BY user_id) WHERE cv <= 1.0",
    "content_dedup": "SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1",
    "dict_bonus": f"""WITH v AS (SELECT DISTINCT word FROM {_WORDS('benchmark')}), b AS (SELECT DISTINCT substr(word, 1, CAST(unnest(range(1, length(word))) AS BIGINT)) AS word FROM v)
      SELECT word, CASE WHEN word IN (SELECT word FROM v) THEN 1.0::DOUBLE WHEN word IN (SELECT word FROM b) THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS bonus FROM (SELECT DISTINCT word FROM {_WORDS('conversations')})""",
    "ocr_png": "SELECT n_nationkey, replace(n_name, '_', '') AS text, 'recognized' AS status, true AS applied, true AS sure FROM nation",
    "ocr_pdf": "SELECT n_nationkey, '[image 1 of 1]' || chr(10) || replace(n_name, '_', '') AS text, 'recognized' AS status, true AS applied, true AS sure FROM nation",
    "ocr_names": "SELECT n_nationkey, replace(n_name, '_', '') AS text, 'recognized' AS status, 'true' AS applied FROM nation",
}
