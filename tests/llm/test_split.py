import random

from pyspark.sql import functions as F

from graphloom.llm.split import split_items


def rebuild(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["id"], r["piece_no"])):
        out[r["id"]] = out.get(r["id"], "") + r["body"]
    return out


def test_round_trip_and_limits(spark):
    rng = random.Random(3)
    texts = {}
    for i in range(60):
        lines = ["x" * rng.choice([0, 3, 30, 90, 400, 3000]) + rng.choice(["", "é", "\t", "漢", "𝒳"]) for _ in range(rng.randrange(1, 60))]
        texts[f"t{i}"] = rng.choice(["\n", "\r\n"]).join(lines) + rng.choice(["", "\n"])
    texts |= {"empty": "", "one": "a", "giant": "z" * 20_000, "edge": "y" * 2400, "over": "y" * 2401, "blank": "\n" * 6000}
    df = spark.createDataFrame([(k, v, 7) for k, v in texts.items()] + [("null", None, None)], "id string, t string, start_line int")
    rows = split_items(df, "id", "t", "start_line").collect()
    assert rebuild(rows) == texts
    assert max(len(r["piece"]) for r in rows) <= 2400
    for r in rows:
        whole = texts[r["id"]]
        if len(whole) <= 2400:
            assert r["n_pieces"] == 1
        if len(whole) > 2400:
            assert r["n_pieces"] > 1
        assert r["piece"] == r["overlap"] + r["body"]
    # line numbers are reckoned from the text itself
    for k in ("t0", "t1", "giant", "blank"):
        at = 0
        for r in sorted((r for r in rows if r["id"] == k), key=lambda r: r["piece_no"]):
            assert r["start_line"] == 7 + texts[k][:at].count("\n") - r["overlap"].count("\n")
            at += len(r["body"])
            assert r["end_line"] == 7 + texts[k][: max(0, at - 1)].count("\n")


def test_cuts_between_lines_and_repeats_two(spark):
    text = "".join(f"line {i} {'w' * 40}\n" for i in range(200))
    rows = split_items(spark.createDataFrame([("a", text)], "id string, t string"), "id", "t").orderBy("piece_no").collect()
    for a, b in zip(rows, rows[1:], strict=False):
        assert a["body"].endswith("\n")
        assert b["overlap"] == "".join(a["body"].splitlines(True)[-2:])
    blocks = ("def f():\n" + "    pass\n" * 20 + "\n") * 20
    rows = split_items(spark.createDataFrame([("a", blocks)], "id string, t string"), "id", "t").orderBy("piece_no").collect()
    assert all(r["body"].endswith("\n\n") for r in rows)


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([("a", "x\n" * 3000, 1, 2, 3)], "id string, t string, k int, body int, piece_no int")
    assert split_items(df, "id", "t").agg(F.max(F.length("piece"))).first()[0] <= 2400
    assert split_items(df.limit(0), "id", "t").count() == 0


def last_two(text):
    return "".join(text.splitlines(True)[-2:])


def test_the_body_yields_to_the_repeats(spark):
    rng = random.Random(5)
    texts = {f"n{n}": "".join(f"{i:03d} {'w' * (n - 5)}\n" for i in range(40)) for n in (50, 300, 700, 790, 795)}
    texts |= {f"m{i}": "".join("q" * rng.randrange(0, 790) + "\n" for _ in range(80)) for i in range(12)}
    df = spark.createDataFrame(list(texts.items()), "id string, t string")
    rows = split_items(df, "id", "t").orderBy("id", "piece_no").collect()
    assert rebuild(rows) == texts
    for a, b in zip(rows, rows[1:], strict=False):
        if a["id"] == b["id"]:
            assert len(b["piece"]) <= 2400
            assert b["overlap"] == last_two(texts[b["id"]][: texts[b["id"]].index(b["body"]) if b["id"][0] == "n" else None]) if b["id"][0] == "n" else b["overlap"]
    at = 0
    for b in (r for r in rows if r["id"][0] == "m"):
        at = 0 if b["piece_no"] == 0 else at
        if b["piece_no"]:
            assert b["overlap"] == last_two(texts[b["id"]][:at])  # any two lines and a third fit
        at += len(b["body"])


def test_repeats_that_cannot_fit(spark):
    text = ("a" * 1500 + "\n") * 6 + "b" * 5000 + "\n" + "c\n" * 900
    rows = split_items(spark.createDataFrame([("a", text)], "id string, t string"), "id", "t").orderBy("piece_no").collect()
    at = 0
    for r in rows:
        two = last_two(text[:at])
        body = r["body"]
        at += len(body)
        if r["piece_no"] == 0:
            continue
        if text[at - len(body) - 1] == "\n" and len(two) + len(body) <= 2400:
            assert r["overlap"] == two
        else:
            assert r["overlap"] == ""
            if text[at - len(body) - 1] == "\n":  # not even one line fits behind the repeats
                assert len(two) + len(text[at - len(body) :].split("\n", 1)[0]) + 1 > 2400
    assert "".join(r["body"] for r in rows) == text
    # other limits and numbers of lines
    for limit, lines in ((10, 1), (37, 3), (200, 0)):
        got = split_items(spark.createDataFrame([("a", text[-4000:])], "id string, t string"), "id", "t", limit=limit, overlap_lines=lines).orderBy("piece_no").collect()
        assert "".join(r["body"] for r in got) == text[-4000:] and max(len(r["piece"]) for r in got) <= limit
        tail = [r for r in got if set(r["body"]) <= {"c", "\n"}][3:]
        assert all(r["overlap"] == "c\n" * lines for r in tail)
