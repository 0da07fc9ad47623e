import random

from lexloom.llm.pages import common_lines, page_differences


def length(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        before = best[:]
        for j, y in enumerate(b):
            best[j + 1] = before[j] + 1 if x == y else max(before[j + 1], best[j])
    return best[-1]


def test_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(12))] for _ in range(2))
        got = common_lines(a, b)
        assert len(got) == length(a, b) and got == sorted(set(got))
        rest = iter(b)
        assert all(a[i] in rest for i in got)


def test_pages(spark):
    rows = [
        ("a", "https://x.example/ley/101", "Menú\nUno\nPie"), ("b", "https://x.example/ley/102", "Menú\nDos\nPie"), ("c", "https://y.example/ley/103", "Menú\nTres"), ("d", None, "Menú"),
        ("e", "no url", "Menú\nX"), ("f", "https://x.example/ley/103", None), (None, "https://x.example/ley/104", "x"), ("g", "https://x.example/ley/105", ""), ("a", "https://x.example/ley/101", "Menú\nUno\nPie"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id string, u string, t string, text int")
    got = {r.key: r for r in page_differences(df, "id", "u", "t").collect()}
    assert set(got) == {"a", "b", "c", "d", "e", "g"}
    assert got["a"].own_text == "Uno" and got["b"].own_text == "Dos" and got["b"].mate == "a" and (got["b"].lines, got["b"].shared) == (3, 2)
    assert got["c"].own_text == "Menú\nTres" and got["d"].shared == 0 and got["e"].mate is None and got["g"].own_text == ""
    assert page_differences(df.limit(0), "id", "u", "t").count() == 0


def test_every_page_of_a_host_with_others_is_paired(spark):
    paths = [("x.example", f"/ley/{n}") for n in (7, 999, 1000, 1299, 1300)] + [("x.example", "/a/b/c")] + [(f"h{k % 3}.example", f"/ley/{k * 37}") for k in range(200)] + [("alone.example", "/ley/1")]
    rows = [(f"{h}{p}", f"https://{h}{p}", f"Menú\n{h}{p}\nPie") for h, p in paths]
    got = {r.key: r for r in page_differences(spark.createDataFrame(rows, "id string, u string, t string").repartition(3), "id", "u", "t").collect()}
    assert len(got) == len(rows) and got["alone.example/ley/1"].mate is None
    for h in {h for h, _ in paths} - {"alone.example"}:
        keys = [h + p for p in sorted(p for g, p in paths if g == h)]
        assert [got[k].mate for k in keys] == [keys[1], *keys[:-1]] and all(got[k].own_text == k for k in keys)
