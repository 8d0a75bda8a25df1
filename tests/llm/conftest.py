import pytest


def rows(df, *columns):
    """Rows as tuples of the given columns, sorted with nulls first."""
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    return sorted(got, key=lambda t: tuple((x is not None, str(type(x)) if x is None else "", x if not isinstance(x, list) else str(x)) for x in t))


@pytest.fixture
def docs(spark):
    def make(texts, **extra):
        """documents of texts with ids from 0; extra: columns of the same length."""
        names = ["doc_id", "text", *extra]
        data = [tuple([i, t, *(v[i] for v in extra.values())]) for i, t in enumerate(texts)]
        return spark.createDataFrame(data, ", ".join(["doc_id bigint", "text string", *(f"{n} string" for n in extra)])).select(*names)

    return make
