import pytest
from hypothesis import given
from hypothesis import strategies as st

from ledgerloom.functions import packed


def values(cell):
    return packed.merged(cell, [])


@pytest.mark.parametrize(
    "cell, want",
    [
        ("A 1; B 2,C 3|D 4\nE 5\tF 6", ["A 1", "B 2", "C 3", "D 4", "E 5", "F 6"]),
        ('"A, x 1"; “B; y 2”', ["A, x 1", "B; y 2"]),
        ('"Shared ""Tier A"" 1"\r\nB', ['Shared "Tier A" 1', "B"]),
        ('["A", "B \\"Core\\" 2"]', ["A", 'B "Core" 2']),
        ('Nordic "Core" List 1 | B', ['Nordic "Core" List 1', "B"]),
        ("- A\n- B\n- C - final", ["A", "B", "C - final"]),
        ("1. 2019 A\n2. B\n", ["2019 A", "B"]),
        ("• A • B", ["A", "B"]),
        ("A_x000D_\nB<br/>C<br/><br/>D", ["A", "B", "C", "D"]),
        (";;A, , B;", ["A", "B"]),
        ("A (x, y) 1; B", ["A (x, y) 1", "B"]),
        ('"Open 1; B', ["Open 1", "B"]),
        ("Manager's List; B", ["Manager's List", "B"]),
        ("", []),
        (" ;, ", []),
    ],
)
def test_cells(cell, want):
    assert values(cell) == want


@given(st.lists(st.text(st.characters(codec="utf-8", exclude_categories=["C", "Z", "P", "S", "M"]), min_size=1, max_size=8), min_size=1, max_size=9), st.sampled_from([";", ", ", " | ", "\n", "\t", "<br>"]), st.booleans())
def test_round_trip(names, sep, quoted):
    cell = sep.join(f'"{n}; {n}"' if quoted else n for n in names)
    assert values(cell) == [f"{n}; {n}" if quoted else n for n in names]


def test_long_cell_is_linear():
    cell = "; ".join(f"Name {i}" for i in range(50_000))
    assert len(values(cell)) == 50_000


def test_operator(spark):
    from ledgerloom.operators.packed_values import packed_values

    cells = spark.createDataFrame([(1, "Budget, Unposted 3; B", "x"), (2, "Budget, Unposted 4", "y"), (3, None, "z"), (4, "n/a", "z"), (5, "B|B", None), (5, "B|B", None)], "id long, cell string, report_name string")
    known = spark.createDataFrame([("BUDGET,  unposted 3", 1), (None, 2), ("plain", 3)], "report_name string, id long")
    out = sorted((r.id, r.value_pos, r.value) for r in packed_values(cells, "cell", known, "report_name").collect())
    assert out == [(1, 1, "Budget, Unposted 3"), (1, 2, "B"), (2, 1, "Budget"), (2, 2, "Unposted 4")] + [(5, 1, "B")] * 2 + [(5, 2, "B")] * 2
    assert packed_values(cells, "cell", known.limit(0), "report_name").where("id = 1").count() == 3
    assert packed_values(cells.limit(0), "cell", known, "report_name").count() == 0


def test_a_dirty_name_costs_only_cells_that_begin_like_it():
    from ledgerloom.functions.packed import first_bucket, spans

    cell = "; ".join(f"Name {k}" for k in range(300)) + "; Zulu; Alpha"
    most = {first_bucket("zulu, alpha"): 1000}
    assert [(a, b, v) for a, b, v in spans(cell, most)] == [(300, 301, "Zulu; Alpha")]
    assert first_bucket("\u200b\xa0FOO, bar") == first_bucket("foo") and first_bucket("Übersicht, neu") == -1 and first_bucket("\u212aelvin; x") == first_bucket("kelvin")


def test_own_key_and_hot_cells(spark, monkeypatch):
    from pyspark.sql import functions as F

    from ledgerloom.operators.packed_values import packed_values

    known = spark.createDataFrame([("Sales, North",), ("Übersicht; alt",), (None,), ("x" + ", y" * 400,)], "name string")
    rows = [(k, "sales, NORTH; other" if k % 3 else "übersicht; ALT, sales") for k in range(60)]
    df = spark.createDataFrame(rows, "id long, cell string")
    for key in (None, lambda c: F.lower(F.btrim(c))):
        out = packed_values(df, "cell", known, "name", *([key] if key else []))
        got = sorted((r.id, r.value_pos, r.value) for r in out.collect())
        assert got == sorted((k, p + 1, v) for k, c in rows for p, v in enumerate(["sales, NORTH", "other"] if k % 3 else ["übersicht; ALT", "sales"]))
