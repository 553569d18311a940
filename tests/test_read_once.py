"""Lines that several steps read are made once: what is read again is read from files."""

import pytest

from tidewatch import catalog
from tidewatch.catalog_outcomes import _judged

DIR = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["plan_sql_text", "par9_type5_ship_static", "par9_type19_extended_class_b", "src9_whole_envelopes"])
def test_sentences_are_made_once(spark, name):
    # what makes them reads the events, which the rest doesn't
    assert "event_id" not in _plan(catalog.queries()[name](spark, DIR))


def test_lines_of_outcomes_are_made_once(spark):
    assert "event_id" not in _plan(_judged(spark, DIR))
