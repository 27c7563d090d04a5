"""Queries over the driver's tables, one for each operator, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions import exprs, plugins
from tempora.operators import evaluate, focus, intervals, select, sequences
from tempora.schema import MotionConfig, SelectConfig
from tempora.sources import adapters
from tempora.streaming import live

DAY, GAP = 86_400.0, 21_600.0
CUES = ["thou", "heat", "that"]
MOTION = MotionConfig(confirm_frames=2, min_segment=3_600.0)

_E = """E AS (SELECT user_id AS video_id, event_id AS seq, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 AS t,
 CASE event_type WHEN 'signup' THEN 'asr' WHEN 'click' THEN 'motion' WHEN 'error' THEN 'motion_end' WHEN 'view' THEN 'keyframe' WHEN 'purchase' THEN 'ocr' END AS type,
 value AS score FROM events)"""
_S = "S AS (SELECT video_id, seq, t AS t0, coalesce(lead(t) OVER (PARTITION BY video_id ORDER BY t, seq), t + 86400.0::DOUBLE) AS t1 FROM E WHERE type = 'asr')"
_C = "C AS (SELECT conv_id AS video_id, turn AS seq, turn * 15.0::DOUBLE AS t, text FROM conversations)"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _events(spark: SparkSession, sf_dir: str, *types: str) -> DataFrame:
    e = adapters.events(spark, sf_dir)
    return e.where(F.col("type").isin(*types)) if types else e


@query(f"""WITH {_E}, {_S} SELECT S.video_id, S.seq, S.t0, S.t1, count(*) FILTER (WHERE E.type LIKE 'motion%') AS linked_motion_events,
 count(*) FILTER (WHERE E.type = 'keyframe') AS linked_keyframes,
 coalesce(string_agg(DISTINCT E.type, ',' ORDER BY E.type) FILTER (WHERE E.type LIKE 'motion%'), '') AS motion_types
 FROM S LEFT JOIN E ON E.video_id = S.video_id AND E.t >= S.t0 AND E.t < S.t1 GROUP BY ALL""")
def align_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return intervals.align(e.where("type = 'asr'"), e, DAY)


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(
        "video_id", "seq", "t", F.when(F.col("score") > 15, 1).otherwise(0).alias("boxes"), (F.col("score") > 30).alias("gated"), F.col("score").alias("ratio")
    )


_M = """F0 AS (SELECT video_id, seq, t, (score > 15)::INT AS boxes, score > 30 AS gated, score AS ratio FROM E),
 F1 AS (SELECT *, coalesce(sum((boxes = 0)::INT) OVER (PARTITION BY video_id ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o,
  sum((NOT gated)::INT) OVER (PARTITION BY video_id ORDER BY t, seq) AS s FROM F0),
 F2 AS (SELECT *, sum((gated AND boxes > 0)::INT) OVER (PARTITION BY video_id, o, s ORDER BY t, seq) AS streak FROM F1),
 F3 AS (SELECT *, max((gated AND boxes > 0 AND streak >= 2)::INT) OVER (PARTITION BY video_id, o ORDER BY t, seq) AS ok FROM F2),
 M AS (SELECT video_id, min(t) FILTER (WHERE ok = 1 AND gated) AS start_t, max(t) FILTER (WHERE ok = 1 AND gated) AS end_t,
  max(ratio) FILTER (WHERE ok = 1 AND gated) AS max_ratio, min(t) FILTER (WHERE boxes = 0) AS closed_t FROM F3 GROUP BY video_id, o HAVING start_t IS NOT NULL)"""


@query(f"WITH {_E}, {_M} SELECT *, end_t - start_t >= 3600 AS kept FROM M")
def motion_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.motion_segments(_frames(spark, sf_dir), MOTION)


@query(f"""WITH {_E}, {_M} SELECT video_id, closed_t AS t, 'segment_anchor' AS reason FROM M WHERE closed_t IS NOT NULL AND NOT EXISTS
 (SELECT 1 FROM E WHERE E.video_id = M.video_id AND type = 'keyframe' AND E.t >= start_t AND E.t < closed_t)""")
def segment_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.segment_anchors(sequences.motion_segments(_frames(spark, sf_dir), MOTION), _events(spark, sf_dir, "keyframe"), DAY)


_R = "SELECT video_id, t AS a, t + 60 * score AS b, seq FROM E WHERE type = 'motion'"


def _merged(ranges: str, gap: str, more: str = "") -> str:
    return f"""R AS ({ranges}), R1 AS (SELECT *, max(b) OVER (PARTITION BY video_id ORDER BY a, b, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM R),
 R2 AS (SELECT *, sum((pm IS NULL OR a > pm + {gap})::INT) OVER (PARTITION BY video_id ORDER BY a, b, seq) AS g FROM R1)
 SELECT video_id, min(a) AS start_t, max(b) AS end_t, count(*) AS n{more} FROM R2 GROUP BY video_id, g"""


@query(f"WITH {_E}, {_merged(_R, '21600')}")
def merge_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir, "motion")
    return intervals.merge_ranges(e.select("video_id", F.col("t").alias("a"), (F.col("t") + 60 * F.col("score")).alias("b"), "seq"), GAP)


_CUE = "CASE " + " ".join(f"WHEN contains(lower(text), '{c}') THEN '{c}'" for c in CUES) + " END"


@query(f"WITH {_C} SELECT video_id, seq, t, {_CUE} AS cue FROM C WHERE cue IS NOT NULL")
def cue_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = adapters.transcripts(spark, sf_dir)
    return c.select("video_id", "seq", "t", exprs.first_cue(F.col("text"), CUES).alias("cue")).where("cue is not null")


@query(f"WITH {_C}, H AS (SELECT video_id, seq, t, {_CUE} AS cue FROM C WHERE cue IS NOT NULL), "
       + _merged("SELECT video_id, t AS a, t AS b, seq, cue FROM H", "15", ", arg_min(cue, (a, b, seq)) AS cue"))
def attention_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = cue_hits(spark, sf_dir).select("video_id", F.col("t").alias("a"), F.col("t").alias("b"), "seq", "cue")
    return intervals.merge_ranges(hits, 15.0, keep="cue")


@query(f"""WITH {_C}, {_merged("SELECT video_id, t AS a, t + 2.0 AS b, seq FROM C WHERE contains(lower(text), 'thou') UNION ALL SELECT video_id, t - 2.0, t + 5.0, seq FROM C WHERE contains(lower(text), 'thou') AND seq % 2 = 0 UNION ALL SELECT video_id, t, t + 5.0, seq FROM C WHERE contains(lower(text), 'heat')", '10')}""")
def candidate_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = adapters.transcripts(spark, sf_dir).withColumn("end_t", F.lit(None).cast("double"))
    windows = c.where(exprs.contains_any(F.col("text"), ["heat"])).select("video_id", "t", F.lit(None).cast("double").alias("end"), "seq")
    return evaluate.candidate_ranges(c, c.where("seq % 2 = 0"), windows, exprs.contains_any(F.col("text"), ["thou"]))


_BG = "CASE WHEN length(x) = 0 THEN []::VARCHAR[] ELSE list_distinct(list_transform(range(1, greatest(length(x) - 1, 1) + 1), lambda i: substr(x, i, 2))) END"


@query(f"""WITH {_C}, X AS (SELECT *, {_BG} AS g FROM (SELECT *, regexp_replace(text, '\\s+', '', 'g') AS x FROM C)),
 P AS (SELECT a.video_id, a.seq, b.seq AS hint_seq, b.t AS r_t, len(list_intersect(a.g, b.g))::DOUBLE AS inter, len(a.g) AS na, len(b.g) AS nb
  FROM X a JOIN X b ON a.video_id = b.video_id AND b.seq % 2 = 1 AND abs(b.t - a.t) <= 15 AND b.seq <> a.seq),
 Q AS (SELECT *, CASE WHEN na = 0 OR nb = 0 THEN 0 ELSE inter / (na + nb - inter) END AS sim FROM P)
 SELECT video_id, seq, hint_seq, sim FROM Q WHERE sim >= 0.2 QUALIFY row_number() OVER (PARTITION BY video_id, seq ORDER BY sim DESC, hint_seq) = 1""")
def reconcile_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = adapters.transcripts(spark, sf_dir).withColumn("g", exprs.bigrams(F.col("text")))
    right = c.where("seq % 2 = 1").select("video_id", F.col("seq").alias("r_seq"), F.col("t").alias("r_t"), F.col("g").alias("rg"))
    sim = F.when(F.col("r_seq") == F.col("seq"), F.lit(-1.0)).otherwise(exprs.jaccard(F.col("g"), F.col("rg")))
    return intervals.band_best(c.drop("text"), right, band=15.0, score=sim, least=0.2).select("video_id", "seq", F.col("r_seq").alias("hint_seq"), "sim")


#: The events' month in 130 seconds, so that offers lie closer than the least distance.
_SQUEEZE = 20_000.0


@query(f"""WITH RECURSIVE {_E}, T AS (SELECT * REPLACE (t / 20000 AS t) FROM E), W AS (SELECT video_id, seq, t, t + 1 AS e FROM T WHERE type = 'asr'), K AS (SELECT * FROM T WHERE type = 'keyframe'),
 N AS (SELECT W.video_id, W.seq, any_value(W.t) AS wt, arg_min(K.t, (abs(K.t - W.t), K.t)) AS t FROM W JOIN K ON K.video_id = W.video_id AND K.t BETWEEN W.t - 5 AND W.e + 5 GROUP BY W.video_id, W.seq),
 Z AS (SELECT video_id, t FROM T WHERE type = 'ocr'),
 O AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY wt, seq) AS k FROM N WHERE NOT EXISTS (SELECT 1 FROM Z WHERE Z.video_id = N.video_id AND abs(Z.t - N.t) < 0.05)),
 B AS (SELECT video_id, k, [round(t, 1)] AS added FROM O WHERE k = 1 UNION ALL
  SELECT O.video_id, O.k, CASE WHEN len(list_filter(B.added, lambda x: abs(x - O.t) < 0.05)) > 0 THEN B.added ELSE list_append(B.added, round(O.t, 1)) END
  FROM B JOIN O ON O.video_id = B.video_id AND O.k = B.k + 1)
 SELECT video_id, t FROM Z UNION ALL SELECT video_id, unnest(added) AS t FROM (SELECT video_id, arg_max(added, k) AS added FROM B GROUP BY video_id)""")
def force_include(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _events(spark, sf_dir).withColumn("t", F.col("t") / _SQUEEZE)
    windows = t.where("type = 'asr'").withColumn("end", F.col("t") + 1)
    return intervals.force_include(t.where("type = 'ocr'"), windows, t.where("type = 'keyframe'"))


_SC = "SC AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY t, seq) - 1 AS scene, t AS start_t, t + 43200 AS end_t FROM E WHERE type = 'asr')"
_AS = """AR AS (SELECT K.video_id, K.seq, K.t, min(SC.scene) AS scene FROM E K LEFT JOIN SC ON SC.video_id = K.video_id AND K.t >= start_t - 1e-6 AND K.t < end_t + 1e-6
 WHERE K.type = 'keyframe' GROUP BY ALL)"""


def _scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("video_id").orderBy("t", "seq")) - 1
    return _events(spark, sf_dir, "asr").select("video_id", k.cast("long").alias("scene"), F.col("t").alias("start_t"), (F.col("t") + 43_200).alias("end_t"))


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _events(spark, sf_dir, "keyframe").select("video_id", "seq", "t")
    return intervals.first_match(k, _scenes(spark, sf_dir), width=DAY)


@query(f"WITH {_E}, {_SC}, {_AS} SELECT video_id, seq, t, coalesce(scene, -1) AS scene FROM AR")
def assign_reps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir).withColumn("scene", F.coalesce("scene", F.lit(-1)).cast("long"))


@query(f"""WITH {_E}, {_SC}, {_AS}, P AS (SELECT video_id, scene, count(*) AS reps FROM AR WHERE scene IS NOT NULL GROUP BY ALL)
 SELECT SC.video_id, count(*) AS scenes, count(*) FILTER (WHERE reps > 0) AS covered, sum(coalesce(reps, 0))::BIGINT AS reps,
 sum(CASE WHEN reps > 0 THEN end_t - start_t ELSE 0 END) / sum(end_t - start_t) AS coverage, sum(coalesce(reps, 0))::DOUBLE / count(*) AS redundancy
 FROM SC LEFT JOIN P ON P.video_id = SC.video_id AND P.scene = SC.scene GROUP BY SC.video_id""")
def semantic_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.coverage(_scenes(spark, sf_dir), _assigned(spark, sf_dir))


@query(f"""WITH {_E}, G AS (SELECT video_id, score, row_number() OVER (PARTITION BY video_id ORDER BY score) AS i FROM E)
 SELECT video_id, floor(coalesce((2 * sum(i * score) - (count(*) + 1) * sum(score)) / nullif(count(*) * sum(score), 0), 0) * 1e9 + 0.5)::BIGINT AS gini_e9 FROM G GROUP BY video_id""")
def redundancy_gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.gini(_events(spark, sf_dir), "score").select("video_id", F.floor(F.col("gini") * 1e9 + 0.5).cast("long").alias("gini_e9"))


@query(f"""WITH {_E}, G AS (SELECT *, lead(t) OVER (PARTITION BY video_id ORDER BY t, seq) - t AS gap FROM E)
 SELECT video_id, count(*) AS n, floor((max(t) - min(t)) * 1e3 + 0.5)::BIGINT AS span_ms, floor(avg(gap) * 1e3 + 0.5)::BIGINT AS mean_ms,
 floor(quantile_cont(gap, 0.95) * 1e3 + 0.5)::BIGINT AS p95_ms, floor(max(gap) * 1e3 + 0.5)::BIGINT AS max_ms FROM G GROUP BY video_id""")
def gap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = lambda c, name: F.floor(F.col(c) * 1e3 + 0.5).cast("long").alias(name)
    g = evaluate.gap_summary(_events(spark, sf_dir))
    return g.select("video_id", "n", ms("span", "span_ms"), ms("mean_gap", "mean_ms"), ms("p95_gap", "p95_ms"), ms("max_gap", "max_ms"))


_CP = "CP AS (SELECT video_id, floor(t / 86400)::BIGINT AS w, abs(arg_max(score, (t, seq)) - arg_min(score, (t, seq))) AS change FROM E GROUP BY ALL)"


@query(f"WITH {_E}, {_CP} SELECT * FROM CP")
def change_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.change_profile(_events(spark, sf_dir), "score", DAY)


@query(f"""WITH {_E}, {_CP}, H AS (SELECT video_id, w * 86400.0::DOUBLE AS t FROM CP WHERE change > 40), K AS (SELECT video_id, t FROM E WHERE type = 'keyframe'),
 V AS (SELECT video_id FROM H UNION SELECT video_id FROM K)
 SELECT V.video_id, coalesce(count(*) FILTER (WHERE H.t IS NOT NULL AND EXISTS (SELECT 1 FROM K WHERE K.video_id = H.video_id AND abs(K.t - H.t) <= 21600))::DOUBLE / nullif(count(H.t), 0), 1.0) AS coverage
 FROM V LEFT JOIN H ON H.video_id = V.video_id GROUP BY V.video_id""")
def old_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = change_profile(spark, sf_dir).where("change > 40").select("video_id", (F.col("w") * F.lit(DAY)).alias("t"))
    return evaluate.changed_coverage(changed, _events(spark, sf_dir, "keyframe"), GAP)


@query(f"""WITH {_E} SELECT video_id, seq, t FROM E a WHERE type = 'motion' AND NOT EXISTS
 (SELECT 1 FROM E b WHERE b.video_id = a.video_id AND b.type = 'asr' AND a.t BETWEEN b.t - 43200 AND b.t + 43200)""")
def far_from_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.far_from_all(_events(spark, sf_dir, "motion"), _events(spark, sf_dir, "asr"), 43_200.0).select("video_id", "seq", "t")


_KINDS = list(adapters.TYPES.values())


@query(f"WITH {_E} SELECT video_id, " + ", ".join(f"count(*) FILTER (WHERE type = '{k}') AS {k}" for k in _KINDS) + ", count(*) AS total FROM E GROUP BY video_id")
def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.type_counts(_events(spark, sf_dir), _KINDS)


@query(f"""WITH {_E}, L AS (SELECT *, lag(type) OVER (PARTITION BY video_id ORDER BY t, seq) AS p FROM E) SELECT video_id, seq, t, type FROM L WHERE p IS DISTINCT FROM type""")
def clean_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.drop_adjacent(_events(spark, sf_dir), "type").select("video_id", "seq", "t", "type")


@query()
def collapse_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = exprs.collapse_loops(F.col("text"))
    return adapters.table(spark, sf_dir, "documents").select("doc_id", clean.alias("text"), (clean != F.col("text")).alias("cleaned"))


@query("""WITH T AS (SELECT doc_id, text, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS l, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS u,
 len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS k FROM documents)
 SELECT doc_id FROM T WHERE regexp_full_match(text, '[A-Za-z\\s''?,.!]{2,60}') AND l > 0 AND (u::DOUBLE / l > 0.8 OR k <= 2)""")
def hallucination_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.table(spark, sf_dir, "documents").where(exprs.is_hallucination(F.col("text"))).select("doc_id")


_GB = """O AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY t, seq) AS k FROM E),
 B AS (SELECT video_id, seq, t, score, k, CASE WHEN t >= 86400 THEN t ELSE 0::DOUBLE END AS bucket FROM O WHERE k = 1
  UNION ALL SELECT O.video_id, O.seq, O.t, O.score, O.k, CASE WHEN O.t >= B.bucket + 86400 THEN O.t ELSE B.bucket END FROM B JOIN O ON O.video_id = B.video_id AND O.k = B.k + 1)"""


@query(f"WITH RECURSIVE {_E}, {_GB} SELECT video_id, seq, t, bucket FROM B")
def greedy_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.greedy_buckets(_events(spark, sf_dir).select("video_id", "seq", "t"), DAY)


@query(f"""WITH RECURSIVE {_E}, {_GB}, D AS (SELECT *, abs(score - first_value(score) OVER (PARTITION BY video_id, bucket ORDER BY t, seq)) AS d FROM B)
 SELECT video_id, bucket, seq, t FROM D QUALIFY row_number() OVER (PARTITION BY video_id, bucket ORDER BY d DESC, t, seq) = 1""")
def bucket_rep_k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    b = select.greedy_buckets(_events(spark, sf_dir).select("video_id", "seq", "t", "score"), DAY)
    first = F.first("score").over(Window.partitionBy("video_id", "bucket").orderBy("t", "seq"))
    w = Window.partitionBy("video_id", "bucket").orderBy(F.desc("d"), "t", "seq")
    return b.withColumn("d", F.abs(F.col("score") - first)).withColumn("k", F.row_number().over(w)).where("k = 1").select("video_id", "bucket", "seq", "t")


_V = "V AS (SELECT label AS video_id, vec_id AS seq, vec_id::DOUBLE AS t, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings)"


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with small pictures: their components in hundredths."""
    return adapters.vectors(spark, sf_dir).withColumn("pixels", F.transform("v", lambda x: x.cast("double") * 100))


def _pixels(a: str, b: str) -> str:
    return f"list_aggregate(list_transform(list_zip({a}, {b}), lambda z: abs(z[1] * 100 - z[2] * 100)), 'avg') / 255 * 100"


def _apart(a: str, b: str) -> str:
    return f"(0.5 * ({_pixels(a, b)}) / 100 + 0.5 * (1 - list_cosine_similarity({a}, {b})))"


@query(f"""WITH RECURSIVE {_V}, B AS (SELECT *, CASE WHEN t >= 100 THEN t ELSE 0::DOUBLE END AS bucket FROM V WHERE k = 1 UNION ALL
  SELECT V.*, CASE WHEN V.t >= B.bucket + 100 THEN V.t ELSE B.bucket END FROM B JOIN V ON V.video_id = B.video_id AND V.k = B.k + 1),
 D AS (SELECT *, first_value(v) OVER (PARTITION BY video_id, bucket ORDER BY t, seq) AS f FROM B),
 A1 AS (SELECT * FROM (SELECT video_id, bucket, seq, t, v, {_apart("v", "f")} AS score FROM D) QUALIFY row_number() OVER (PARTITION BY video_id, bucket ORDER BY score DESC, t, seq) = 1),
 R2 AS (SELECT D.video_id, D.bucket, D.seq, D.t, D.v, {_apart("D.v", "A1.v")} AS score FROM D JOIN A1 ON A1.video_id = D.video_id AND A1.bucket = D.bucket AND A1.seq <> D.seq),
 A2 AS (SELECT * FROM R2 QUALIFY row_number() OVER (PARTITION BY video_id, bucket ORDER BY score DESC, t, seq) = 1),
 R3 AS (SELECT R2.video_id, R2.bucket, R2.seq, R2.t, R2.v, least(R2.score, {_apart("R2.v", "A2.v")}) AS score FROM R2 JOIN A2 ON A2.video_id = R2.video_id AND A2.bucket = R2.bucket AND A2.seq <> R2.seq),
 A3 AS (SELECT * FROM R3 QUALIFY row_number() OVER (PARTITION BY video_id, bucket ORDER BY score DESC, t, seq) = 1)
 SELECT video_id, seq, t, bucket, floor(score * 1e6 + 0.5)::BIGINT AS score_e6 FROM (FROM A1 UNION ALL FROM A2 UNION ALL FROM A3)""")
def fps_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = select.representatives(_pictures(spark, sf_dir), SelectConfig(interval=100.0, k=3))
    return r.select("video_id", "seq", "t", "bucket", F.floor(F.col("score") * 1e6 + 0.5).cast("long").alias("score_e6"))


@query(f"""WITH RECURSIVE {_V}, B AS (SELECT *, CASE WHEN t >= 50 THEN t ELSE 0::DOUBLE END AS bucket, 50::DOUBLE AS width, v AS f, 0::DOUBLE AS spread FROM V WHERE k = 1 UNION ALL
  SELECT video_id, seq, t, v, k, CASE WHEN opens THEN t ELSE bucket END, CASE WHEN NOT opens THEN width WHEN spread < 7 THEN least(width * 2, 200) WHEN spread > 7.6 THEN greatest(width / 2, 25) ELSE width END,
  CASE WHEN opens THEN v ELSE f END, CASE WHEN opens THEN 0 ELSE greatest(spread, {_pixels("v", "f")}) END
  FROM (SELECT V.*, B.bucket, B.width, B.f, B.spread, V.t >= B.bucket + B.width AS opens FROM B JOIN V ON V.video_id = B.video_id AND V.k = B.k + 1)),
 A AS (SELECT video_id, seq, t, bucket, {_apart("v", "f")} AS score FROM B)
 SELECT video_id, seq, t, bucket, floor(score * 1e6 + 0.5)::BIGINT AS score_e6 FROM A QUALIFY row_number() OVER (PARTITION BY video_id, bucket ORDER BY score DESC, t, seq) = 1""")
def adaptive_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = SelectConfig(interval=50.0, k=1, grow_below=7.0, shrink_above=7.6)
    r = select.representatives(_pictures(spark, sf_dir), config, adaptive=True)
    return r.select("video_id", "seq", "t", "bucket", F.floor(F.col("score") * 1e6 + 0.5).cast("long").alias("score_e6"))


@query(f"""WITH RECURSIVE {_V}, B AS (SELECT *, v AS last, true AS kept FROM V WHERE k = 1 UNION ALL
  SELECT video_id, seq, t, v, k, CASE WHEN far THEN v ELSE last END, far FROM (SELECT V.*, B.last, 1 - list_cosine_similarity(V.v, B.last) >= 0.9 AS far FROM B JOIN V ON V.video_id = B.video_id AND V.k = B.k + 1))
 SELECT video_id, seq, t FROM B WHERE kept""")
def seq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.drop_similar(adapters.vectors(spark, sf_dir), 0.9)


@query("""WITH P AS (SELECT label AS video_id, vec_id AS seq, embedding::DOUBLE[] AS v, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings)
 SELECT video_id, seq, floor((1 - list_cosine_similarity(v, p)) * 1e6 + 0.5)::BIGINT AS dist_e6 FROM P WHERE p IS NOT NULL""")
def cosine_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    v = adapters.vectors(spark, sf_dir).withColumn("p", F.lag("v").over(Window.partitionBy("video_id").orderBy("t", "seq"))).where("p is not null")
    return v.select("video_id", "seq", F.floor(exprs.cosine_distance(F.col("v"), F.col("p")) * 1e6 + 0.5).cast("long").alias("dist_e6"))


@query("""WITH P AS (SELECT label AS video_id, vec_id AS seq, embedding::DOUBLE[] AS v, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings),
 Q AS (SELECT video_id, seq, list_transform(v, lambda x: x > list_aggregate(v, 'sum') / 64) AS a, list_transform(p, lambda x: x > list_aggregate(p, 'sum') / 64) AS b FROM P WHERE p IS NOT NULL)
 SELECT video_id, seq, len(list_filter(range(1, 65), lambda i: a[i] <> b[i]))::INT AS distance FROM Q""")
def phash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    v = adapters.vectors(spark, sf_dir).withColumn("h", exprs.sign_hash(F.col("v"))).withColumn("p", F.lag("h").over(Window.partitionBy("video_id").orderBy("t", "seq")))
    return v.where("p is not null").select("video_id", "seq", exprs.hamming(F.col("h"), F.col("p")).cast("int").alias("distance"))


@query(f"""WITH {_E}, X AS (SELECT video_id, seq, t, list({{'t': t, 'x': CASE type WHEN 'asr' THEN 1.5 WHEN 'ocr' THEN 0.5 ELSE 1.0 END::DOUBLE * score / 100}}) OVER (PARTITION BY video_id ORDER BY t, seq ROWS 19 PRECEDING) AS h FROM E)
 SELECT video_id, seq, floor(list_sum(list_transform(list_filter(h, lambda y: y.t >= X.t - 259200.0::DOUBLE), lambda y: y.x)) * 1e6 + 0.5)::BIGINT AS budget_e6 FROM X""")
def budget_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _events(spark, sf_dir).withColumn("weight", F.col("score") / 100)
    b = sequences.budget_scores(s, 259_200.0, 1.5, {"asr": 1.5, "ocr": 0.5}, last=20)
    return b.select("video_id", "seq", F.floor(F.col("budget") * 1e6 + 0.5).cast("long").alias("budget_e6"))


@query(f"""WITH {_E} SELECT video_id, seq, left(sha256(printf('%.3f', t) || chr(124) || type), 12) AS event_key FROM E""")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("video_id", "seq", exprs.provenance(F.col("t"), F.array("type")).alias("event_key"))


@query(f"""WITH {_E} SELECT video_id, seq, t, greatest(count(*) OVER (PARTITION BY video_id) - 30, 0) AS dropped FROM E
 QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY t DESC, seq DESC) <= 30""")
def bounded_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.keep_newest(_events(spark, sf_dir), 30).select("video_id", "seq", "t", "dropped")


@query("""SELECT page_id FROM pages QUALIFY sum(length(html)) OVER (PARTITION BY page_id % 4 ORDER BY page_id DESC) <= 40000""")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = adapters.table(spark, sf_dir, "pages").select((F.col("page_id") % 4).alias("group"), F.col("page_id").alias("name"), F.length("html").alias("size"))
    return sequences.retained(p, 40_000).select(F.col("name").alias("page_id"))


@query(f"""WITH {_E} SELECT video_id, seq, n_over FROM (SELECT video_id, seq, sum((score > 60)::INT) OVER (PARTITION BY video_id ORDER BY t, seq ROWS 4 PRECEDING)::BIGINT AS n_over FROM E) WHERE n_over >= 3""")
def drift_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.hard_drift(_events(spark, sf_dir), F.col("score") > 60).select("video_id", "seq", "n_over")


@query(f"""WITH {_E}, W AS (SELECT video_id, seq, avg(score) OVER w AS m, count(*) OVER w AS n FROM E WINDOW w AS (PARTITION BY video_id ORDER BY t RANGE BETWEEN 259200.0::DOUBLE PRECEDING AND CURRENT ROW))
 SELECT video_id, seq, n, floor(m * 1e6 + 0.5)::BIGINT AS mean_e6 FROM W WHERE n >= 2 AND m > 60""")
def drift_soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sequences.trailing(_events(spark, sf_dir), "score", 259_200.0).where("n >= 2 and mean_v > 60")
    return d.select("video_id", "seq", "n", F.floor(F.col("mean_v") * 1e6 + 0.5).cast("long").alias("mean_e6"))


_CORR = """((score - m) * (rscore - rm) + (100 - score - m) * (100 - rscore - rm) + (q - m) * (rq - rm))
 / sqrt(((score - m) ** 2 + (100 - score - m) ** 2 + (q - m) ** 2) * ((rscore - rm) ** 2 + (100 - rscore - rm) ** 2 + (rq - rm) ** 2))"""


@query(f"""WITH RECURSIVE {_E}, F AS (SELECT video_id, seq, t / 3600 AS t, score, ((seq % 7) * 10)::DOUBLE AS q, (seq * 40503) % 65536 AS h, type = 'motion' AS moves, row_number() OVER (PARTITION BY video_id ORDER BY t, seq) AS k FROM E),
 B AS (SELECT video_id, k, seq, t, 'first_frame' AS reason, t AS lt, score AS rscore, q AS rq, [h] AS hs, []::BOOLEAN[] AS ov, []::STRUCT(t DOUBLE, s DOUBLE)[] AS so FROM F WHERE k = 1 UNION ALL
  SELECT video_id, k, seq, t, why, CASE WHEN why IS NULL THEN lt ELSE t END, CASE WHEN why IS NULL THEN rscore ELSE score END, CASE WHEN why IS NULL THEN rq ELSE q END,
   CASE WHEN why IS NULL THEN hs ELSE list_append(hs, h)[-5:] END, CASE WHEN why IS NOT NULL THEN [] WHEN checked THEN ov2 ELSE ov END, CASE WHEN why IS NOT NULL THEN [] WHEN checked THEN so2 ELSE so END
  FROM (SELECT *, CASE WHEN NOT checked THEN NULL
    WHEN d <= 10 THEN CASE WHEN len(so2) >= 2 AND list_aggregate(list_transform(so2, lambda x: x.s), 'avg') > 6 THEN 'gradual_drift' END
    WHEN bit_count(xor(h, hs[-1])) > 9 OR {_CORR} < 0.5 THEN CASE WHEN len(list_filter(hs, lambda x: bit_count(xor(x, h)) < 5)) = 0 THEN 'scene_change' END
    WHEN len(list_filter(ov2, lambda x: x)) >= 3 THEN 'gradual_drift' END AS why
   FROM (SELECT *, list_append(ov, d > 10)[-5:] AS ov2, list_filter(list_append(so, {{'t': t, 's': d}}), lambda x: t - x.t <= 30) AS so2
    FROM (SELECT F.*, B.lt, B.rscore, B.rq, B.hs, B.ov, B.so, abs(F.score / 4 - B.rscore / 4) AS d, (100 + F.q) / 3 AS m, (100 + B.rq) / 3 AS rm,
      F.t - B.lt >= 1 AND (F.moves OR F.t - B.lt > 3) AS checked FROM B JOIN F ON F.video_id = B.video_id AND F.k = B.k + 1))))
 SELECT video_id, seq, t, reason FROM B WHERE reason IS NOT NULL""")
def keyframe_acceptor(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    frames = e.select(
        "video_id", "seq", (F.col("t") / 3600).alias("t"), F.array(F.col("score") / 4).alias("grey"), (F.col("seq") * 40503 % 65536).alias("phash"),
        F.array(F.col("score"), 100 - F.col("score"), (F.col("seq") % 7 * 10).cast("double")).alias("hist"), (F.col("type") == "motion").alias("motion"),
    )
    return sequences.accept_keyframes(frames, MotionConfig(phash_distance=9))


@query(f"""WITH {_E}, S AS (SELECT video_id, seq, t AS start_t, t + 43200 AS end_t FROM E WHERE type = 'asr'),
 K AS (SELECT S.video_id, S.seq, E.t, row_number() OVER (PARTITION BY S.video_id, S.seq ORDER BY E.t) AS k FROM S JOIN E ON E.video_id = S.video_id AND E.type = 'keyframe' AND E.t BETWEEN start_t AND end_t)
 SELECT video_id, seq, count(*) AS keyframes_in_range, max(t) FILTER (WHERE k = 1) AS f1, max(t) FILTER (WHERE k = 2) AS f2, max(t) FILTER (WHERE k = 3) AS f3 FROM K GROUP BY ALL""")
def evidence_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _events(spark, sf_dir, "asr").select("video_id", "seq", F.col("t").alias("start_t"), (F.col("t") + 43_200).alias("end_t"))
    hit = intervals.interval_join(s, _events(spark, sf_dir, "keyframe").select("video_id", "t"), lo="start_t", hi="end_t", at="t", width=43_200.0)
    f = hit.groupBy("video_id", "seq").agg(F.count("*").alias("keyframes_in_range"), F.array_sort(F.collect_list("t")).alias("f"))
    return f.select("video_id", "seq", "keyframes_in_range", *[F.get("f", F.lit(i)).alias(f"f{i + 1}") for i in range(3)])


@query(f"""WITH {_E}, {_S}, K AS (SELECT video_id, t FROM E WHERE type = 'keyframe'),
 L AS (SELECT S.video_id, S.seq, S.t0, S.t1, CASE WHEN S.seq % 3 = 0 THEN 'said' ELSE '' END AS speech, count(*) FILTER (WHERE E.type LIKE 'motion%') AS motion, count(*) FILTER (WHERE E.type = 'keyframe') AS linked
  FROM S LEFT JOIN E ON E.video_id = S.video_id AND E.t >= S.t0 AND E.t < S.t1 WHERE S.t1 > S.t0 GROUP BY ALL),
 I AS (SELECT L.video_id, L.seq, list(K.t ORDER BY K.t) AS f FROM L JOIN K ON K.video_id = L.video_id AND K.t BETWEEN t0 AND t1 GROUP BY ALL),
 H AS (SELECT L.video_id, L.seq, arg_min(K.t, (abs(K.t - t0), K.t)) AS a, arg_min(K.t, (abs(K.t - t1), K.t)) AS b FROM L JOIN K ON K.video_id = L.video_id GROUP BY ALL),
 A AS (SELECT DISTINCT L.video_id, L.seq FROM L JOIN E W ON W.video_id = L.video_id AND W.type = 'ocr' AND t0 <= W.t + 3600 AND W.t <= t1),
 P AS (SELECT L.*, CASE WHEN f IS NOT NULL THEN f[1:3] WHEN least(abs(a - t0), abs(b - t1)) <= 43200 THEN list_sort(list_distinct([a, b])) ELSE [] END AS fr,
  list_filter([CASE WHEN speech <> '' THEN 'speech' END, CASE WHEN motion > 0 THEN 'motion' END, CASE WHEN linked > 0 THEN 'keyframe' END, CASE WHEN A.seq IS NOT NULL THEN 'attention' END], lambda x: x IS NOT NULL) AS why
  FROM L LEFT JOIN I ON I.video_id = L.video_id AND I.seq = L.seq LEFT JOIN H ON H.video_id = L.video_id AND H.seq = L.seq LEFT JOIN A ON A.video_id = L.video_id AND A.seq = L.seq)
 SELECT video_id, printf('ev_%04d', row_number() OVER (PARTITION BY video_id ORDER BY t0, seq) - 1) AS event_id, t0 AS start_t, t1 AS end_t, speech, linked AS keyframes_in_range,
 array_to_string(list_transform(fr, lambda x: floor(x * 1000 + 0.5)::BIGINT::VARCHAR), ',') AS frames, array_to_string(why, ',') AS reasons, least(1.0, len(why) / 4.0)::DOUBLE AS confidence FROM P WHERE len(why) > 0""")
def evidence_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    said = F.when(F.col("seq") % 3 == 0, F.lit("said")).otherwise(F.lit(""))
    s = align_segments(spark, sf_dir).select(
        "video_id", "seq", F.col("t0").alias("start_t"), F.col("t1").alias("end_t"), said.alias("text"), F.col("linked_motion_events").alias("motion"), F.col("linked_keyframes").alias("linked")
    )
    windows = e.where("type = 'ocr'").withColumn("end", F.col("t") + 3600)
    packs = evaluate.evidence_packs(s, e.where("type = 'keyframe'"), windows, reach=43_200.0, width=DAY)
    ms = F.transform("frames", lambda x: F.floor(x * 1000 + 0.5).cast("string"))
    return packs.withColumn("frames", F.array_join(ms, ",")).withColumn("reasons", F.array_join("reasons", ","))


@query(f"""WITH {_E} SELECT DISTINCT S.video_id, S.seq FROM (SELECT video_id, seq, t AS a, t + 43200 AS b FROM E WHERE type = 'asr') S
 JOIN (SELECT video_id, t, t + 3600 AS e FROM E WHERE type = 'ocr') W ON W.video_id = S.video_id AND S.a <= W.e AND W.t <= S.b""")
def overlap_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _events(spark, sf_dir, "asr").select("video_id", "seq", F.col("t").alias("start_t"), (F.col("t") + 43_200).alias("end_t"))
    w = _events(spark, sf_dir, "ocr").withColumn("end", F.col("t") + 3600)
    return intervals.overlap_semi(s, w, 43_200.0).select("video_id", "seq")


@query("""WITH I AS (SELECT source, doc_id, n_chars % 1900 + 20 AS w, n_chars % 1000 + 20 AS h, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k FROM documents),
 S AS (SELECT source, k // 9 AS sheet, count(*) AS n, max(w) AS cw, max(h) AS ch, sum(w * h // 750 + 1) AS direct FROM I GROUP BY ALL)
 SELECT source, sum(direct)::BIGINT AS direct_tokens, sum((cw * least(n, 3)) * (ch * ceil(n / 3.0)::BIGINT) // 750 + 1)::BIGINT AS grid_tokens, count(*) AS sheets FROM S GROUP BY source""")
def token_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapters.table(spark, sf_dir, "documents").select(
        F.col("source").alias("video_id"), F.col("doc_id").alias("seq"), F.col("doc_id").cast("double").alias("t"), (F.col("n_chars") % 1900 + 20).alias("w"), (F.col("n_chars") % 1000 + 20).alias("h")
    )
    return evaluate.grid_tokens(d).withColumnRenamed("video_id", "source")


@query("""SELECT page_id, regexp_matches(lower(url), '^https://[^/]+') OR regexp_matches(lower(url), '^http://(localhost|127\\.0\\.0\\.1)([:/?#]|$)') AS allowed,
 NOT list_contains(string_split(replace(url, '\\', '/'), '/'), '..') AS safe FROM pages""")
def url_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.table(spark, sf_dir, "pages").select("page_id", exprs.url_allowed(F.col("url")).alias("allowed"), exprs.path_safe(F.col("url")).alias("safe"))


@query(f"""WITH {_E} SELECT video_id, seq, last_value(CASE WHEN type = 'motion' THEN score END IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS motion_ratio FROM E""")
def carried_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("motion_ratio", F.when(F.col("type") == "motion", F.col("score")))
    return sequences.carried_forward(e, "motion_ratio").select("video_id", "seq", "motion_ratio")


@query(f"""WITH {_C} SELECT video_id, max(t) AS t_now, greatest(0, max(t) - max(t) FILTER (WHERE seq % 3 = 0)) AS lag FROM C GROUP BY video_id""")
def coverage_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = adapters.transcripts(spark, sf_dir)
    covered = F.max(F.when(F.col("seq") % 3 == 0, F.col("t")))
    return c.groupBy("video_id").agg(F.max("t").alias("t_now"), F.greatest(F.lit(0.0), F.max("t") - covered).alias("lag"))


@query(f"""WITH {_E} SELECT video_id, arg_max(seq, (t, seq)) AS seq, max(t) AS t, arg_max(type, (t, seq)) AS type FROM E GROUP BY video_id""")
def latest_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("t", "seq")
    return _events(spark, sf_dir).groupBy("video_id").agg(F.max_by("seq", order).alias("seq"), F.max("t").alias("t"), F.max_by("type", order).alias("type"))


@query(f"""WITH RECURSIVE {_E}, O AS (SELECT video_id, seq, t, row_number() OVER (PARTITION BY video_id ORDER BY t, seq) AS k FROM E),
 B AS (SELECT *, t AS last, true AS due FROM O WHERE k = 1 UNION ALL
  SELECT O.*, CASE WHEN O.t - B.last >= 86400 THEN O.t ELSE B.last END, O.t - B.last >= 86400 FROM B JOIN O ON O.video_id = B.video_id AND O.k = B.k + 1)
 SELECT video_id, seq, t FROM B WHERE due""")
def anchors_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.guaranteed_anchors(_events(spark, sf_dir).select("video_id", "seq", "t"), DAY)


@query(f"""WITH {_C}, R AS (SELECT *, t + 15 AS end_t, row_number() OVER (PARTITION BY video_id ORDER BY t DESC, seq DESC) AS k FROM C)
 SELECT video_id, seq, t, end_t, text, false AS chapter FROM R WHERE k <= 3 UNION ALL
 SELECT video_id, -1, min(t), arg_max(end_t, (t, seq)), coalesce(string_agg(text, '；' ORDER BY t, seq) FILTER (WHERE text <> ''), ''), true FROM R WHERE k > 3 GROUP BY video_id""")
def compact_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = adapters.transcripts(spark, sf_dir).withColumn("end_t", F.col("t") + 15)
    return sequences.compact_timeline(c, 3)


@query(f"""WITH {_C} SELECT a.video_id, a.seq, coalesce(string_agg(b.text, '|' ORDER BY b.t, b.seq), '') AS texts FROM C a
 LEFT JOIN C b ON b.video_id = a.video_id AND b.seq % 2 = 1 AND b.t <= a.t + 20 AND b.t + 2.0 >= a.t - 20 GROUP BY a.video_id, a.seq""")
def rep_subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = adapters.transcripts(spark, sf_dir)
    s = c.where("seq % 2 = 1").select("video_id", F.col("seq").alias("s_seq"), F.col("t").alias("s_t"), (F.col("t") + 2.0).alias("s_end"), F.col("text").alias("s_text"))
    return intervals.texts_around(c.drop("text"), s, 20.0).select("video_id", "seq", F.array_join("texts", "|").alias("texts"))


@query(f"""WITH {_E}, {_CP} SELECT video_id, w, change FROM CP QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY change DESC, w) <= 3""")
def top_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.top_changes(change_profile(spark, sf_dir))


@query(f"""WITH {_E}, {_SC} SELECT K.video_id, K.seq, min(SC.scene) AS scene FROM E K JOIN SC ON SC.video_id = K.video_id AND K.t >= start_t AND K.t < end_t
 WHERE K.type = 'keyframe' GROUP BY ALL""")
def scene_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.scene_of(_events(spark, sf_dir, "keyframe").select("video_id", "seq", "t"), _scenes(spark, sf_dir), width=DAY)


@query(f"""WITH {_E}, {_SC}, {_AS} SELECT video_id, scene, count(*) AS n FROM AR WHERE scene IS NOT NULL GROUP BY ALL""")
def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir).where("scene is not null").groupBy("video_id", "scene").agg(F.count("*").alias("n"))


@query(f"""WITH {_C}, P AS (SELECT *, coalesce(lag(text) OVER (PARTITION BY video_id ORDER BY t, seq), '') AS p FROM C)
 SELECT video_id, seq, CASE WHEN starts_with(text, p) THEN substr(text, length(p) + 1) ELSE text END AS delta FROM P""")
def text_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.text_delta(adapters.transcripts(spark, sf_dir)).select("video_id", "seq", "delta")


@query()
def clean_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.clean_segments(adapters.transcripts(spark, sf_dir))


@query(f"""WITH {_E} SELECT video_id, seq, CASE WHEN score / 5000 >= 0.01 THEN 'strong_motion' WHEN score / 5000 > 0 THEN 'weak_motion' ELSE 'static' END AS label,
 CASE WHEN score / 5000 >= 0.01 THEN 0.9 WHEN score / 5000 > 0 THEN 0.6 ELSE 0.7 END::DOUBLE AS score FROM E""")
def motion_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("video_id", "seq", exprs.motion_label(F.col("score") / 5000).alias("m")).select("video_id", "seq", "m.label", "m.score")


@query(f"""WITH {_E} SELECT video_id, seq, coalesce(CASE WHEN seq % 3 = 0 THEN t END, CASE WHEN seq % 2 = 1 THEN seq / 25.0::DOUBLE END, seq * 0.02::DOUBLE) AS t FROM E""")
def frame_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    clock = F.when(F.col("seq") % 3 == 0, F.col("t"))
    return e.select("video_id", "seq", exprs.frame_time(clock, F.col("seq"), F.col("seq") % 2 * 25.0).alias("t"))


@query(f"""WITH {_E}, X AS (SELECT video_id, seq, t + seq % 5 AS token, t AS a, t + 2 AS b FROM E) SELECT video_id, seq, CASE WHEN token BETWEEN a - 1e-6 AND b + 1e-6 THEN token ELSE a END AS t FROM X""")
def token_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = exprs.token_segment_time(F.col("t") + F.col("seq") % 5, F.col("t"), F.col("t") + 2)
    return _events(spark, sf_dir).select("video_id", "seq", at.alias("t"))


@query(f"""WITH {_V}, P AS (SELECT *, lag(v) OVER (PARTITION BY video_id ORDER BY t, seq) AS p FROM V) SELECT video_id, seq, floor({_apart("v", "p")} * 1e6 + 0.5)::BIGINT AS apart_e6 FROM P WHERE p IS NOT NULL""")
def blended_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("video_id").orderBy("t", "seq")
    v = _pictures(spark, sf_dir).withColumn("p", F.lag("v").over(w)).withColumn("q", F.lag("pixels").over(w)).where("p is not null")
    d = exprs.blended(exprs.mean_abs_percent(F.col("pixels"), F.col("q")), exprs.cosine_distance(F.col("v"), F.col("p")), 0.5)
    return v.select("video_id", "seq", F.floor(d * 1e6 + 0.5).cast("long").alias("apart_e6"))


@query(f"""WITH {_E} SELECT video_id, seq, CASE WHEN seq % 4 > 0 THEN floor(t) + 0.5 END AS t FROM E""")
def file_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("kf/kf_"), F.col("seq"), F.when(F.col("seq") % 4 > 0, F.lit("_t")).otherwise(F.lit("_x")), F.floor("t").cast("string"), F.lit(".5s.jpg"))
    return _events(spark, sf_dir).select("video_id", "seq", exprs.file_time(name).alias("t"))


@query(f"""WITH {_C} SELECT video_id, seq, right(text, 20) AS tail FROM C""")
def text_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.transcripts(spark, sf_dir).select("video_id", "seq", exprs.tail(F.col("text"), 20).alias("tail"))


@query(f"""WITH {_E} SELECT video_id, seq, least(60.0, 2.0 * 2.0 ** (seq % 9))::DOUBLE AS seconds FROM E""")
def retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("video_id", "seq", exprs.backoff(F.col("seq") % 9 + 1).alias("seconds"))


@query(f"""WITH {_E}, N AS (SELECT video_id, score / 1000 AS s FROM E QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY seq DESC) <= 20), M AS (SELECT video_id, avg(s) AS m FROM N GROUP BY video_id)
 SELECT E.video_id, count(*) FILTER (WHERE type LIKE 'motion%') AS motion_events, count(*) FILTER (WHERE type = 'keyframe') AS keyframes, count(*) AS events,
 floor(any_value(m) * 1e9 + 0.5)::BIGINT AS mean_ns, floor(1e3 / any_value(m) + 0.5)::BIGINT AS fps_e3 FROM E JOIN M ON M.video_id = E.video_id GROUP BY E.video_id""")
def pipeline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    p = evaluate.pipeline_summary(e, e.select("video_id", "seq", (F.col("score") / 1000).alias("seconds")), last=20)
    return p.select("video_id", "motion_events", "keyframes", "events", F.floor(F.col("mean_seconds") * 1e9 + 0.5).cast("long").alias("mean_ns"), F.floor(F.col("fps") * 1e3 + 0.5).cast("long").alias("fps_e3"))


@query(f"""WITH {_E}, M AS (SELECT type AS name, count(*)::DOUBLE AS value FROM E GROUP BY type), S AS (SELECT * FROM (VALUES ('asr', 1.0, NULL), ('motion', NULL, 5.0), ('ocr', 1.0, 1e9), ('absent', 0.0, 1.0)) v(name, least, most)),
 R AS (SELECT S.name, coalesce(value >= coalesce(least, value) AND value <= coalesce(most, value), false) AS passed FROM S LEFT JOIN M ON M.name = S.name)
 SELECT * FROM R UNION ALL SELECT 'all', bool_and(passed) FROM R""")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = _events(spark, sf_dir).groupBy(F.col("type").alias("name")).agg(F.count("*").cast("double").alias("value"))
    specs = spark.createDataFrame([("asr", 1.0, None), ("motion", None, 5.0), ("ocr", 1.0, 1e9), ("absent", 0.0, 1.0)], "name string, least double, most double")
    return evaluate.verdicts(measured, specs)


@query(f"""WITH {_E}, A AS (SELECT video_id, list(DISTINCT floor(t)::BIGINT) FILTER (WHERE type = 'keyframe') AS k, list(DISTINCT floor(t)::BIGINT) FILTER (WHERE type = 'asr') AS a FROM E GROUP BY video_id)
 SELECT video_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(k, []), coalesce(a, []))))[-10:], ',') AS times FROM A""")
def keyframe_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = lambda k: F.collect_set(F.when(F.col("type") == k, F.floor("t").cast("long"))).alias(k)
    a = _events(spark, sf_dir).groupBy("video_id").agg(times("keyframe"), times("asr"))
    return a.select("video_id", F.array_join(exprs.keyframe_union(F.col("keyframe"), F.col("asr")).cast("array<string>"), ",").alias("times"))


@query(f"""WITH {_E}, A AS (SELECT video_id, type, arg_max(score, (t, seq)) FILTER (WHERE seq % 2 = 0) AS old, arg_max(score, (t, seq)) FILTER (WHERE seq % 2 = 1) AS new FROM E GROUP BY ALL)
 SELECT video_id, string_agg(type || '=' || floor(coalesce(new, old) * 100 + 0.5)::BIGINT, ',' ORDER BY type) AS entities FROM A GROUP BY video_id""")
def entity_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("t", "seq")
    kept = lambda odd: F.max_by("score", F.when(F.col("seq") % 2 == odd, order))
    a = _events(spark, sf_dir).groupBy("video_id", "type").agg(F.count_if(F.col("seq") % 2 == 0).alias("n0"), kept(0).alias("old"), F.count_if(F.col("seq") % 2 == 1).alias("n1"), kept(1).alias("new"))
    side = lambda n, v: F.map_from_entries(F.filter(F.collect_list(F.when(F.col(n) > 0, F.struct("type", v))), lambda x: x.isNotNull()))
    merged = a.groupBy("video_id").agg(exprs.entities_merged(side("n0", "old"), side("n1", "new")).alias("m"))
    lines = F.transform(F.array_sort(F.map_entries("m")), lambda x: F.concat(x["key"], F.lit("="), F.floor(x["value"] * 100 + 0.5).cast("long").cast("string")))
    return merged.select("video_id", F.array_join(lines, ",").alias("entities"))


@query(f"""WITH {_E}, G AS (WITH {_merged(_R, "21600")}), P AS (SELECT E.video_id, start_t, end_t, seq, t, row_number() OVER (PARTITION BY E.video_id, start_t, end_t ORDER BY t, seq) - 1 AS k
 FROM G JOIN E ON E.video_id = G.video_id AND E.t BETWEEN start_t AND end_t) SELECT video_id, start_t, end_t, seq, t FROM P WHERE k % 3 = 0""")
def range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return focus.frames_within(_events(spark, sf_dir).select("video_id", "seq", "t"), merge_ranges(spark, sf_dir), 3, DAY)


@query(f"""WITH {_E} SELECT video_id, seq, CASE WHEN seq % 20 < 8 THEN 'unknown' WHEN score / 10 >= 2 AND (seq % 11) / 10.0 >= 0.7 AND score % 9 < 4 THEN 'camera' ELSE 'foreground' END AS verdict FROM E""")
def camera_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq, score = F.col("seq"), F.col("score")
    return _events(spark, sf_dir).select("video_id", "seq", exprs.motion_verdict(seq % 20, score / 10, seq % 11 / 10.0, score % 9).alias("verdict"))


@query(f"""WITH {_E} SELECT video_id, seq, printf('kf_%04d_t%.1fs.jpg', seq, t) AS kf, printf('rep_%02d_t%04ds.jpg', seq, floor(t)::BIGINT) AS rep FROM E""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return e.select("video_id", "seq", exprs.keyframe_name(F.col("seq"), F.col("t")).alias("kf"), exprs.representative_name(F.col("seq"), F.col("t")).alias("rep"))


@query("""SELECT doc_id, sha256(text) AS digest FROM documents""")
def text_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text"), 256).alias("digest"))


@query(f"""WITH {_C}, L AS (SELECT video_id, seq, t, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS line, generate_subscripts(string_split(replace(text, chr(10), ' '), ' '), 1) - 1 AS item FROM C)
 SELECT video_id, seq, item, t, trim(line) AS text, (length(line) % 100) / 100.0::DOUBLE AS conf FROM L WHERE trim(line) <> ''""")
def read_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = adapters.transcripts(spark, sf_dir)
    return plugins.read_text(c.select("video_id", "seq", "t", F.encode(F.translate("text", " ", "\n"), "UTF-8").alias("content")), "mock")


@query(f"""WITH {_C} SELECT video_id AS run, max(t) + 15 AS audio_s, count(*) / 8.0::DOUBLE AS decode_s, count(*) AS segments, sum(length(text))::BIGINT AS chars,
 count(*) / 8.0::DOUBLE / (max(t) + 15) AS rtf FROM C GROUP BY video_id""")
def speech_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = adapters.transcripts(spark, sf_dir).withColumnRenamed("video_id", "run")
    runs = c.groupBy("run").agg((F.max("t") + 15).alias("audio_s"), (F.count("*") / F.lit(8.0)).alias("decode_s"))
    return evaluate.speech_totals(c, runs)


@query(f"""WITH {_E}, R AS (SELECT video_id, arg_min(score, seq) AS first_score, min(seq) AS run FROM E WHERE type = 'ocr' GROUP BY video_id)
 SELECT E.video_id, seq, run, first_score FROM E LEFT JOIN R ON R.video_id = E.video_id WHERE type = 'keyframe'""")
def run_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _events(spark, sf_dir, "ocr").select("video_id", F.col("seq").alias("run"), F.col("score").alias("first_score"))
    return evaluate.lookup(_events(spark, sf_dir, "keyframe").select("video_id", "seq"), runs, "video_id", "run")


_DUE = """CASE WHEN {new}.type = 'asr' THEN true WHEN NOT {new}.strong THEN {old}.due
 WHEN NOT {new}.suspect THEN true WHEN {old}.since IS NULL OR {new}.t - {old}.since < 259200 THEN {old}.due ELSE true END"""


@query(f"""WITH RECURSIVE {_E}, O AS (SELECT video_id, seq, t, type, type IN ('asr', 'keyframe') AS opens, seq % 3 = 0 AS suspect,
  (type = 'keyframe' AND seq % 10 > 0) OR (type = 'motion_end' AND score >= 50) AS strong, row_number() OVER (PARTITION BY video_id ORDER BY t, seq) AS k FROM E),
 Z AS (SELECT DISTINCT video_id, 0::BIGINT AS k, -1::BIGINT AS seq, NULL::DOUBLE AS t, NULL::DOUBLE AS last, NULL::DOUBLE AS since, false AS due, NULL::DOUBLE AS t0, 0.0::DOUBLE AS t1, []::DOUBLE[] AS kf, 0::BIGINT AS m,
  false AS fires, NULL::DOUBLE AS f0, 0.0::DOUBLE AS f1, 0::BIGINT AS fk, 0::BIGINT AS fm FROM E),
 B AS (SELECT * FROM Z UNION ALL (WITH N AS (SELECT O.*, B.last, CASE WHEN NOT O.strong THEN B.since WHEN NOT O.suspect THEN NULL WHEN B.since IS NULL THEN O.t WHEN O.t - B.since < 259200 THEN B.since END AS since2,
   {_DUE.format(new="O", old="B")} AS due2, CASE WHEN O.opens THEN coalesce(B.t0, O.t) ELSE B.t0 END AS s0, CASE WHEN O.opens THEN greatest(B.t1, O.t) ELSE B.t1 END AS s1,
   CASE WHEN O.type = 'keyframe' THEN list_sort(list_distinct(list_append(B.kf, O.t)))[-10:] ELSE B.kf END AS kf2, B.m + (O.type = 'motion_end')::BIGINT AS m2 FROM B JOIN O ON O.video_id = B.video_id AND O.k = B.k + 1),
  D AS (SELECT *, due2 AND (last IS NULL OR t - last >= 86400) AS asks FROM N)
  SELECT video_id, k, seq, t, CASE WHEN asks AND s0 IS NOT NULL THEN t ELSE last END, since2, due2 AND NOT asks, CASE WHEN asks THEN NULL ELSE s0 END, CASE WHEN asks AND s0 IS NOT NULL THEN 0.0 ELSE s1 END,
   CASE WHEN asks AND s0 IS NOT NULL THEN [] ELSE kf2 END, CASE WHEN asks AND s0 IS NOT NULL THEN 0 ELSE m2 END, asks AND s0 IS NOT NULL, s0, s1, len(kf2), m2 FROM D))
 SELECT video_id, seq, t, f0 AS t0, f1 AS t1, fk AS keyframes, fm AS motion_n FROM B WHERE fires""")
def understanding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    strong = F.when((F.col("type") == "keyframe") & (F.col("seq") % 10 == 0), F.lit("first_frame")).otherwise(F.lit("scene_change"))
    e = _events(spark, sf_dir).withColumn("reason", strong).withColumn("ego_suspect", F.col("seq") % 3 == 0).withColumn("duration", F.col("score"))
    told = live.understood(e, lambda: lambda speech, keyframes: '{"now": "seen"}', floor=DAY, motion=50.0, defer=3 * DAY)
    return told.select("video_id", "seq", "t", "t0", "t1", "keyframes", "motion_n")
