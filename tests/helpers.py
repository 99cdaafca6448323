"""Shared by the tests."""

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def rows(df) -> list[tuple]:
    """A frame's rows, columns and rows in order, all kinds of missing values as None."""
    import pandas as pd

    df = df[sorted(df.columns)].astype(object)
    plain = [tuple(None if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x) else x for x in r) for r in df.itertuples(index=False, name=None)]
    return sorted(plain, key=lambda r: [(x is not None, str(x)) for x in r])
