from corvane.llm import queries


def test_each_operator_has_one_query_and_sql_is_text():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 14)]
    assert set(queries.ORACLE) <= set(queries.QUERIES)
    assert all(isinstance(v, str) for v in queries.ORACLE.values())
