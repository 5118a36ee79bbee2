"""What several test modules share."""

DATA = "/root/testdata/sf0.001"


def same(frame, relation) -> None:
    """Both hold the same rows, whatever their order."""
    columns = sorted(frame.columns)
    assert sorted(relation.columns) == columns
    got = sorted(repr(tuple(r)) for r in frame.select(*[f"`{c}`" for c in columns]).collect())
    expected = sorted(map(repr, relation.project(", ".join(f'"{c}"' for c in columns)).fetchall()))
    assert got == expected
