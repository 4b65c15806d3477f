"""Patterns over texts don't stand in a filter that Spark infers for exploded arrays."""

import pytest

import __spark_entry__ as entry
from evidentia.operators import money as M
from tests.conftest import SF


@pytest.mark.parametrize("name, part", [("j08_text_edges", "кодекс"), ("f15_audit_money", "рубл")])
def test_no_filter_runs_them_again(spark, name, part):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert part in plan and not any(part in line for line in plan.splitlines() if line.strip(" +-:").startswith("Filter"))


def test_reserved_marks_in_a_text(spark):
    texts = ["сумма﷐ 5﷑ 100 руб. и сто (100) рублей", "сто двадцать пять (125) рублей, двести (200) руб."]
    rows = M.audit_money(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t").collect()
    assert sorted((r["id"], int(r["amount"]), r["status"]) for r in rows) == [(0, 100, "no_words"), (0, 100, "ok"), (1, 125, "ok"), (1, 200, "ok")]
