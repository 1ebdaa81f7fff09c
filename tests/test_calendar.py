from datetime import datetime
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from nightframe.functions import calendar as c, curves as cv
from nightframe.plans import calendar as plans


def at(zone, *wall, fold=0):
    return int(datetime(*wall, tzinfo=ZoneInfo(zone), fold=fold).timestamp())


NY, BERLIN = "America/New_York", "Europe/Berlin"


def test_occurrences_over_both_changes_of_the_clocks(spark):
    jobs = spark.createDataFrame([(1, "30 2 * * 0", NY), (2, "30 1 * * 0", NY), (3, "0 7 * * *", BERLIN), (4, "x y * * z", NY), (5, None, NY), (6, "0 25 * * 1", NY), (7, "0 6 1 * 1", NY), (8, "0 12 * * 7", None)], "id int, cron string, zone string")
    spring = c.occurrences(jobs, at(NY, 2024, 3, 9), at(NY, 2024, 3, 11)).collect()
    got = lambda i, rows: sorted(r["at"] for r in rows if r["id"] == i)
    assert got(1, spring) == [at("UTC", 2024, 3, 10, 7, 30)]  # skipped: read with the offset before, 03:30 by the clock
    assert {r["id"] for r in spring} == {1, 2, 3, 8} and got(8, spring) == [at("UTC", 2024, 3, 10, 12)]
    autumn = c.occurrences(jobs, at(NY, 2024, 11, 2), at(NY, 2024, 11, 4)).collect()
    assert got(2, autumn) == [at(NY, 2024, 11, 3, 1, 30)]  # of two the first
    europe = c.occurrences(jobs.filter("id = 3"), at(BERLIN, 2024, 3, 30), at(BERLIN, 2024, 4, 1, 7)).collect()
    assert got(3, europe) == [at(BERLIN, 2024, 3, 30, 7), at(BERLIN, 2024, 3, 31, 7), at(BERLIN, 2024, 4, 1, 7)]


def test_next_set_point_is_strictly_later_and_within_the_week(spark):
    points = spark.createDataFrame([("a", 1, 420, 70, True), ("a", 1, 420, 65, True), ("a", 3, 60, 72, True), ("a", 0, 0, 50, False), ("b", 0, 600, 61, True), ("c", 9, 1, 1, True), ("a", 2, None, 1, True)], "k string, day int, minute int, temperature int, enabled boolean")
    asked = [("a", at(NY, 2024, 3, 10, 12), NY), ("a", at(NY, 2024, 3, 11, 7), NY), ("a", at(NY, 2024, 3, 13, 1), NY), ("b", at(NY, 2024, 3, 10, 10), NY), ("b", at(NY, 2024, 3, 9, 23), NY), ("c", 0, NY), ("d", 0, None), ("a", None, NY)]
    rows = c.next_event(spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "i int, k string, t long, zone string"), points, ["k"]).collect()
    got = {r["i"]: (r["next_at"], r["next_temperature"]) for r in rows}
    assert got[0] == (at(NY, 2024, 3, 11, 7), 65) and got[1] == (at(NY, 2024, 3, 13, 1), 72) and got[2] == (at(NY, 2024, 3, 18, 7), 65)
    assert got[3] == (None, None) and got[4] == (at(NY, 2024, 3, 10, 10), 61)
    assert got[5] == got[6] == (None, None) and len(got) == 8


def test_the_session_zone_does_not_matter(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", z)
            row = spark.range(1).select(c.local_seconds(F.lit(at(NY, 2024, 7, 1, 22)), F.lit(NY)).alias("l"), c.instant(F.lit(at("UTC", 2024, 7, 1, 22)), F.lit(NY)).alias("i")).first()
            assert tuple(row) == (at("UTC", 2024, 7, 1, 22), at(NY, 2024, 7, 1, 22))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_a_usual_night():
    got = cv.knots(22 * 60, 7 * 60, "balanced", None, None)
    assert [m for m, *_ in got] == [-45, -30, -15, 0, 20, 41, 61, 81, 108, 135, 173, 210, 225, 240, 255, 375, 495, 510, 525, 540, 550, 560, 570]
    assert [o for _, o, _ in got] == [0, 1, 1, 2, 1, -3, -5, -7, -9, -12, -12, -12, -10, -8, -6, -6, -6, -2, 2, 6, 4, 2, 0]
    assert min(o for _, o, _ in got) == -12 and max(o for _, o, _ in got) == 6


@pytest.mark.parametrize("bed, wake, n", [(0, 0, 23), (1320, 1325, 22), (1320, 1440 - 1, 22), (600, 720, 22)])
def test_short_and_whole_days_stay_in_order(bed, wake, n):
    got = cv.knots(bed, wake, "cool", 60, 90)
    assert len(got) == n and [m for m, *_ in got] == sorted(m for m, *_ in got)
    assert {o for _, o, _ in got} >= {0, -20, 10}


def test_curves_join_schedules_and_become_maps(spark):
    rows = spark.createDataFrame([(1, 1320, 420, None, None, None), (2, None, 420, "cool", None, None), (3, 1439, 1, "warm", 70.0, 85.0)], "id int, bed int, wake int, intensity string, low double, high double")
    points = cv.curves(rows)
    assert {r["id"]: r["count"] for r in points.groupBy("id").count().collect()} == {1: 23, 3: 22}
    maps = {r["id"]: r["curve"] for r in cv.set_points(points, ["id"]).collect()}
    assert maps[1]["21:15"] == 80 and maps[1]["22:00"] == 82 and maps[1]["07:00"] == 86 and len(maps[1]) == 23
    assert len(maps[3]) < 22 and maps[3]["00:01"] == 85


def test_a_map_of_set_points_needs_no_rows_for_its_knots(spark):
    rows = [(i, i * 37 % 1440 if i % 29 else None, (i * 53 + 400) % 1440 if i % 31 else None, ("cool", None, "warm")[i % 3], None if i % 7 == 0 else 60.0 + i % 9, 81.0 + i % 9) for i in range(200)]
    schedules = spark.createDataFrame(rows, "id int, bed int, wake int, intensity string, low double, high double")
    grouped = {r["id"]: r["curve"] for r in cv.set_points(cv.curves(schedules), ["id"]).collect()}
    got = {r["id"]: r["curve"] for r in cv.with_set_points(schedules).collect()}
    assert got == grouped and 180 < len(got) < 200
    twice = spark.createDataFrame([(8,), (3,), (8,), (29,), (None,)], "id long")
    curves = plans.curve_map(twice)
    assert sorted(r["id"] for r in curves.collect()) == [3, 8]
    assert "PythonUDTF" not in curves._jdf.queryExecution().executedPlan().toString()
