import pytest

from seqspark.operators import groups
from seqspark.oracles import ORACLES
from seqspark.queries import QUERIES
from seqspark.sources import views
from tests.compare import DATA, assert_same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(name, spark):
    assert_same(QUERIES[name], ORACLES[name], spark)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_whole_vector_has_all_columns(spark):
    df = groups.group_features(views.short(spark, DATA))
    assert len(df.columns) == len(set(df.columns)) == 434
    assert set(df.columns) - set(QUERIES["group_vectors"](spark, DATA).columns) == {"rp_gzip_ratio", "rp_lz76_norm"}
    assert df.where("group_id IS NULL").count() == 0
