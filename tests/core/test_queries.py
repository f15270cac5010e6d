import pytest
from pyspark.sql import functions as F

import tessera.plans  # noqa: F401
from tessera.functions import geometry
from tessera.plans.registry import QUERIES, SQL
from tessera.plans.views import people, posed
from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_what_its_sql_gives(spark, data, name):
    assert_same(spark, data, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_every_box_of_a_frame_takes_part_in_the_assignments(spark, data):
    boxes = {tuple(r) for r in people(spark, data).select("frame_id", "det_id").collect()}
    overlaps = QUERIES["j6_truth_assignment"](spark, data).collect()
    assert {(r["frame_id"], r["truth"]) for r in overlaps} == boxes == {(r["frame_id"], r["pred"]) for r in overlaps}
    # A pose lies in its own box, so all poses of a frame can be assigned at once.
    poses = posed(spark, data).where(geometry.torso_centre(F.col("kp")).isNotNull())
    want = {tuple(r) for r in poses.select("frame_id", "det_id").collect()}
    got = QUERIES["j4_pose_assignment"](spark, data).collect()
    assert {(r["frame_id"], r["pose"]) for r in got} == want and {r["track"] for r in got} == set(range(8))
