"""Costly expressions are computed once for each line, whatever is asked of the sentences."""

from pyspark.sql import functions as F

from trackloom.operators import nmea
from trackloom.plans.session import computed_once
from trackloom.registry import load_all, sentences

LINES = [
    (1, 0, "$GPGSV,1,1,02,01,40,083,46,02,17,308,41"),
    (1, 1, "$GPGSV,1,1,00*79"),
    (1, 2, "$GPRMC,120000.00,A,4730.0000,N,00820.0000,E,,2.0,010124,,,A"),
    (1, 3, "  "),
    (1, 4, None),
    (1, 5, "no sentence"),
    (1, 6, "$GPGSV,1,1,00*00"),
    (1, 7, "bad � bytes"),
]

LOG = [
    (1, 0, "$GPRMC,120000.00,A,4730.0000,N,00820.0000,E,,2.0,010124,,,A"),
    (1, 1, "$GPGSV,2,1,05,01,40,083,46"),
    (1, 2, "$GPRMC,130000.00,A,4730.0000,N,00820.0000,E,,2.0,010124,,,A"),
    (2, 0, "$GPGSV,2,1,05,01,40,083,46"),
    (None, 0, "$GPRMC,120000.00,A,4730.0000,N,00820.0000,E,,2.0,010124,,,A"),
    (None, 1, "$GPGSV,2,1,05,01,40,083,46"),
]


def test_tokens_of_sound_and_unsound_lines(spark):
    lines = spark.createDataFrame(LINES, "track_id bigint, line_no bigint, value string")
    found = {r["line_no"]: r for r in nmea.tokenize(lines).collect()}
    assert {n: r["status"] for n, r in found.items()} == {0: "parsed", 1: "parsed", 2: "parsed", 5: "malformed", 6: "malformed", 7: "other"}
    assert {n: (r["talker_id"], r["sentence_type"]) for n, r in found.items() if r["fields"]} == {0: ("GP", "GSV"), 1: ("GP", "GSV"), 2: ("GP", "RMC")}
    fields = {r["line_no"]: r for r in nmea.extract_fields(nmea.tokenize(lines)).collect()}
    assert [s["prn"] for s in fields[0]["gsv_satellites"]] == [1, 2] and fields[1]["gsv_satellites"] == []
    assert fields[2]["rmc_speed_knots"] is None and fields[2]["rmc_true_course"] == 2.0


def test_checksums_are_in_the_plan_of_satellites_once_for_making_and_once_for_reading(spark, tmp_path):
    load_all()
    spark.range(3).selectExpr("id event_id", "id user_id", "timestamp_ntz'2024-01-01' ts", "'error' event_type", "1.0D value").write.parquet(f"{tmp_path}/events.parquet")
    plan = sentences.extract_gsv(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") <= 2 and plan.count("regexp_extract(") <= 2


def test_a_checksum_is_the_xor_of_characters(spark):
    texts = ["", "GP,1", None, "\u00e91", "\U0001f600a", "", "ab", "GPGSV,1,1,00"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, t string")
    found = [r["c"] for r in df.select("n", nmea.xor_checksum(F.col("t")).alias("c")).orderBy("n").collect()]
    assert found == ["00", "0A", None, "D8", "1F", "00", "03", "79"]


def test_lines_are_made_outside_whole_stage_code_and_their_characters_are_not_split(spark, tmp_path):
    load_all()
    spark.range(3).selectExpr("id event_id", "id user_id", "timestamp_ntz'2024-01-01' ts", "'error' event_type", "1.0D value").write.parquet(f"{tmp_path}/events.parquet")
    plan = sentences._tokens(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and plan.count("xor_of_characters(") == 2 and plan.count("filter(array(") == 1


def test_the_last_clock_of_a_track_needs_no_second_pass_over_its_lines(spark):
    clocked = nmea.carry_clock(nmea.extract_fields(nmea.tokenize(spark.createDataFrame(LOG, "track_id bigint, line_no bigint, value string"))))
    groups = nmea.group_gsv(clocked)
    # the grammar has two groups
    assert groups._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 2
    found = {(r["track_id"], r["line_no"]): r["h"] for r in groups.select("track_id", "line_no", F.hour("ts").alias("h")).collect()}
    assert found == {(1, 1): 13, (2, 0): None, (None, 1): None}


def test_computed_once_keeps_rows_and_nulls(spark):
    df = computed_once(spark.range(3), {"a": F.when(F.col("id") > 0, F.col("id") * 2), "b": F.lit("x")}).where("a > 2")
    assert [tuple(r) for r in df.collect()] == [(2, 4, "x")]
