import __spark_entry__ as entry


def test_registry_is_sound(spark, sf_dir):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert all(f"p{n}_found" in q for n in (1, 2, 4, 5))
    assert entry.entry(spark).count() > 0
