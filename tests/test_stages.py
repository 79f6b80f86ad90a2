from pathlib import Path

from tagweave import session
from tagweave.plans import QUERIES


def test_what_queries_write_on_their_way_can_go(spark, sf):
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before, mark = set(folder.glob("tagweave-*")), session.stages_written()
    for name in ("d09_personalised_pagerank", "n09_auc_by_concept", "m04_stratified_folds"):
        assert QUERIES[name](spark, sf).collect()
    assert set(folder.glob("tagweave-*")) > before and session.stages_written() > mark
    session.release_stages(spark, mark)
    assert set(folder.glob("tagweave-*")) == before and session.stages_written() == mark


def test_a_table_is_dropped_once(spark):
    df = session.stage_table(spark.range(3), "numbers")
    path = Path(df._tagweave_path.removeprefix("file://"))
    assert df.count() == 3 and path.exists()
    session.drop_stage(df)
    session.drop_stage(df)
    session.drop_stage(spark.range(1))
    assert not path.exists()
