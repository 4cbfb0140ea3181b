"""Tables saved match by match."""

import pytest
from pyspark.sql import functions as F

from touchline import schema
from touchline.sources import tables


@pytest.fixture
def counted(spark):
    """A computation that notes which matches it was asked for."""
    asked = []

    def compute(missing):
        asked.append(sorted(r["match_id"] for r in missing.collect()))
        frames = missing.where("match_id <> 3").withColumn("frame_num", F.explode(F.sequence(F.lit(0), F.col("match_id") + 1)))
        return frames.withColumns({"dx": F.col("frame_num") * 1.5, "dy": F.lit(0.0), "batch": F.lit("clash")})

    return compute, asked


def ids(spark, *numbers):
    return spark.createDataFrame([(n,) for n in numbers], "match_id long")


def rows_of(df):
    return sorted((r["match_id"], r["frame_num"]) for r in df.collect())


def want(*numbers):
    return sorted((m, k) for m in numbers if m != 3 for k in range(m + 2))


def test_an_added_match_costs_itself_alone(spark, counted, tmp_path):
    compute, asked = counted
    load = lambda *m: tables.load_or_compute_matches(spark, f"file://{tmp_path}/t", schema.CAMERA, ids(spark, *m), compute)
    assert rows_of(load(1, 2, 2)) == want(1, 2)
    assert rows_of(load(2)) == want(2)
    found = load(1, 2, 3, 4)
    assert rows_of(found) == want(1, 2, 4) and found.columns == schema.CAMERA.names
    assert rows_of(load(3)) == []  # known to have no rows
    assert asked == [[1, 2], [3, 4]]
    assert rows_of(load()) == []


def test_a_broken_write_is_never_seen(spark, counted, tmp_path):
    compute, asked = counted
    path = f"file://{tmp_path}/t"

    def broken(missing):
        """Rows of match 1 get written; a task of match 2 fails until the job does."""
        bad = F.when(F.col("match_id") == 2, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("dx"))
        return compute(missing).withColumn("dx", bad)

    with pytest.raises(Exception, match="lost"):
        tables.load_or_compute_matches(spark, path, schema.CAMERA, ids(spark, 1, 2), broken)
    assert tables.committed_matches(spark, path).count() == 0
    # Rows that were all written, but whose batch was never committed: the driver died between the two.
    compute(ids(spark, 1, 2)).withColumns({"dy": F.lit(9.0), "batch": F.lit("dead")}).write.mode("append").partitionBy("batch", "match_id").parquet(f"{path}/rows")
    found = tables.load_or_compute_matches(spark, path, schema.CAMERA, ids(spark, 1, 2), compute)
    assert rows_of(found) == want(1, 2) and {r["dy"] for r in found.collect()} == {0.0}
    assert asked[-1] == [1, 2]


def test_two_writers_of_a_match_count_once(spark, counted, tmp_path):
    compute, _ = counted
    path = f"file://{tmp_path}/t"
    tables.load_or_compute_matches(spark, path, schema.CAMERA, ids(spark, 1), compute)
    compute(ids(spark, 1)).withColumn("batch", F.lit("zzz")).write.mode("append").partitionBy("batch", "match_id").parquet(f"{path}/rows")
    ids(spark, 1).withColumn("batch", F.lit("zzz")).write.mode("append").parquet(f"{path}/_matches")
    assert rows_of(tables.load_or_compute_matches(spark, path, schema.CAMERA, ids(spark, 1), compute)) == want(1)


def test_a_go_computes_its_own_matches_alone(spark, monkeypatch):
    """Each of the two goes of the saved queries is given the rows of its matches, and not those of all."""
    from touchline.plans import queries
    from touchline.sources.fixtures import Fixtures

    given = []
    build = lambda detections: given.append({r["match_id"] for r in detections.select("match_id").distinct().collect()}) or tracks(detections)
    tracks = queries.tracks.build_tracks
    monkeypatch.setattr(queries.tracks, "build_tracks", build)
    found = queries.s1_s2_tracks_saved(Fixtures(spark, "/root/testdata/sf0.001"))
    assert len(given) == 2 and not given[0] & given[1] and given[0] | given[1] == {r["match_id"] for r in found.select("match_id").distinct().collect()}
