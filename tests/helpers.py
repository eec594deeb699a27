"""Shared by the tests."""

SMALL = "/root/testdata/sf0.001"


def plain(rows):
    """Rows as sorted tuples with numbers made comparable."""
    one = lambda v: round(float(v), 6) if isinstance(v, float) else v
    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)
