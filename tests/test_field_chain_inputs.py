"""The chain of fields works its inputs out once, for the hours it needs, with the rows that the whole tables give."""

import os

import pytest
from pyspark.sql import functions as F

from zephyrframe.operators import anchors
from zephyrframe.plans import catalog as C
from zephyrframe.plans import samples as S
from zephyrframe.settings import DEFAULTS
from zephyrframe.sources import readings

SF = "/root/testdata/sf0.01"
FIRST = C.CUTOFF_HOUR - DEFAULTS.retention_hours - 2

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


def test_the_chain_reads_no_events_again(spark):
    # All three sets of anchors hang on stored rows; before, the plan held the events for each of them.
    assert C.QUERIES["field_chain"](spark, SF).inputFiles() == []


def rows(df):
    return sorted(tuple(repr(v) for v in r) for r in df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]).collect())


def test_anchors_of_the_day_are_those_of_the_whole_tables(spark):
    known, live = C._day_before(spark, SF, FIRST)
    posts = S.posts(spark)
    whole = readings.within(S.hourly(spark, SF), "bucket_start", C.at(FIRST), C.at(C.CUTOFF_HOUR))
    h = readings.within(known, "bucket_start", C.at(FIRST), C.at(C.CUTOFF_HOUR))
    for make in (anchors.analysis_anchors, anchors.nowcast_anchors):
        got = rows(make(h, posts, live))
        assert got and got == rows(make(whole, posts, S.live(spark, SF)))
    got = rows(anchors.forecast_anchors(S.predictions_of(known), h, posts, live))
    want = rows(anchors.forecast_anchors(S.predictions(spark, SF), whole, posts, S.live(spark, SF)))
    assert got and got == want
