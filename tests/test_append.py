from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import functions as F

from cairnlake.session import ensure_checkpoint_dir
from cairnlake.sources.lake import Lake, validations
from cairnlake.streaming.live import materialize, rebuild
from tests.test_lake import made, state


def kept(spark):
    folder = urlsplit(ensure_checkpoint_dir(spark)).path
    return {str(p) for p in Path(folder).rglob("*") if p.is_file()}


def test_batches_leave_no_copies(spark, tmp_path):
    visits, docs, contents = made(spark)
    before = kept(spark)
    lake = Lake(spark, str(tmp_path))
    lake.append({"visits": visits.unionByName(visits), "documents": docs})
    materialize(lake, visits, docs, contents)
    assert lake.append({"visits": visits}).version == 2
    assert kept(spark) == before
    found = {str(p.parent) for p in tmp_path.rglob("*.parquet")}
    assert found == {f for fs in lake.manifest().tables.values() for f in fs} and set(validations(lake).values()) == {0}


def test_links_of_a_known_content_come_from_its_stored_elements(spark, tmp_path):
    visits, docs, contents = made(spark)
    a, b = Lake(spark, str(tmp_path / "a")), Lake(spark, str(tmp_path / "b"))
    for lake in (a, b):
        lake.append({"visits": visits, "documents": docs})
    rebuild(a, contents)
    materialize(b, visits.where(F.col("visit_id") == "v0"), docs, contents)
    # The content of v1 is known: its page isn't asked for again, while that of v2 is.
    materialize(b, visits, docs, contents.where("html LIKE '%fish%'"))
    assert state(a) == state(b)
