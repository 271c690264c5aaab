"""The colour model against its SQL, to all digits that are kept."""

import duckdb
import pytest

from quillon.operators import foreground as M
from quillon.plans import foreground as P
from quillon.sources.shared import kept

DIR = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    cells = P._cells(spark, DIR)
    models = kept(M.prototypes(cells, P.DEPTH))
    return cells, models, kept(M.regions_of(cells, models, M.region_seeds(cells, models, P.DEPTH), P.DEPTH, P.SAMPLES))


def rows(sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DIR}/embeddings.parquet'")
    return sorted(con.execute(sql).fetchall())


def test_confidence_of_regions_to_nine_digits(model):
    got = model[2].select("image_id", "region", "prototype.confidence", "reliable").collect()
    assert sorted(map(tuple, got)) == rows(f"{P._MODEL} SELECT image_id, region, confidence, reliable FROM regions")


def test_likeness_to_nine_digits(model):
    """Five digits hide a difference in the ninth but where it lies at a cut, which large tables meet."""
    want = rows(f"{P._LIKENESS} SELECT image_id, x, y, {', '.join(f'round({n}, 9)' for n in P._NAMES)} FROM done")
    assert sorted(map(tuple, M.similarities(*model).select("image_id", "x", "y", *P._NAMES).collect())) == want
