"""Queries do their whole job: nothing is left out by a number, and results don't pass through the driver."""

import os

from skylane.plans import demo
from skylane.plans import more_queries  # noqa: F401  registers more
from skylane.plans.queries import QUERIES, SKEW_S

SF = "/root/testdata/sf0.001"


def test_stream_writes_to_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    files = [x.removeprefix("file://") for x in QUERIES["r3_stream_latest"](spark, SF).inputFiles()]
    assert files and all(x.startswith(f"{shared}/") and x.endswith(".parquet") for x in files)
    assert os.path.isdir(f"{os.path.dirname(os.path.dirname(files[0]))}/checkpoint/offsets")


def test_every_event_is_a_prediction(spark):
    assert QUERIES["e1_j14_match_events"](spark, SF).count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_every_position_is_asked_for(spark):
    assert QUERIES["j8_point_precedence"](spark, SF).count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_pairs_are_those_of_blocking(spark):
    sf = "/root/testdata/sf0.01"  # users up to 150, so partners may be further apart than 20
    found = {(r.flight_id_1, r.flight_id_2) for r in demo.state_pairs(spark, sf, 0.25, SKEW_S).collect()}
    assert found == {(r.flight_id_1, r.flight_id_2) for r in QUERIES["j2_blocking_pairs"](spark, sf).collect()}
    assert any(abs(int(a) - int(b)) > 20 for a, b in found)
