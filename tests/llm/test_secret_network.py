"""The network of the secret scan on secrets that no rule finds."""

from __future__ import annotations

import random
import string

import numpy as np
import pyarrow as pa

from quarry.llm import secret_scan


def planted() -> tuple[list[tuple], dict]:
    rnd = random.Random(4)
    take = lambda chars, n: "".join(rnd.choice(chars) for _ in range(n))
    word = lambda: take(string.ascii_lowercase, rnd.randint(2, 9))
    mixed = string.ascii_letters + string.digits
    rows, hidden = [], {}
    for i in range(900):
        before, after = (" ".join(word() for _ in range(40)) for _ in range(2))
        secret, kind = "", i % 9
        if kind == 0:
            secret = "password=" + take(mixed, 20)
        elif kind == 1:
            secret = "AKIA" + take(string.ascii_uppercase + string.digits, 16)
        elif kind == 2:
            secret = "key " + take("0123456789abcdef", 32)
        elif kind == 3:  # no rule finds these
            secret = ("sk_live_" + take(mixed, 24), "ey0J" + take(mixed, 32), take(mixed, 22) + "7x+/" + take(mixed, 14))[i // 9 % 3]
            hidden[i] = (len(before) + 1, len(before) + 1 + len(secret))
        elif kind == 4:
            secret = "-".join(word() for _ in range(5))
        rows.append((i, f"{before} {secret} {after}"))
    return rows, hidden


def test_secrets_beyond_the_rules(spark):
    rows, hidden = planted()
    assert not any(secret_scan.findings(rows[i][1])[0] for i in hidden)
    got = {r["doc_id"]: r["spans"] for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(f"model:{a}:{b}" in got[i].split(",") for i, (a, b) in hidden.items())
    print("planted", len(hidden), "found", found)
    assert found >= 0.9 * len(hidden)
    assert not any(got[i] for i in got if i % 9 > 3)


def test_calibration_and_recall():
    rng = np.random.default_rng(1)
    z = rng.normal(0, 3, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 * z - 1)))).astype(int)
    slope, offset = secret_scan.calibration(1 / (1 + np.exp(-z)), y)
    assert abs(slope - 0.5) < 0.06 and abs(offset + 1) < 0.15


def test_windows_cover_long_candidates():
    for n in (16, 48, 49, 71, 72, 73, 200, 1000):
        text = "x" * 30 + "a" * n + "y" * 30
        got = secret_scan.windows(text, 30, 30 + n)
        assert len(got) == 1 if n <= 48 else len(got) > 1
        for at in range(n):  # each character is seen
            marked = text[: 30 + at] + "7" + text[30 + at + 1 :]
            inside = slice(secret_scan.LEFT, secret_scan.LEFT + secret_scan.INSIDE)
            assert any((w[inside] == 27).any() for w in secret_scan.windows(marked, 30, 30 + n)), (n, at)


def test_key_at_the_end_of_a_path(spark):
    rows, _ = planted()
    model = secret_scan.train(spark.createDataFrame(rows, "doc_id long, text string"))
    head = "/home/of/the/people/in/some/very/long/path/without/any/sign/"
    for key in ("Zk38fQ0xLmT6vB2nR9sWc4Yd7Hj1", "q8ZtR4mXw2Lk9VbN7cPf3Jh6Dg5S"):
        text = f"see {head}{key} for more"
        at = (4, 3, 4 + len(head + key))
        assert secret_scan.spans_of([text], model)[0][1] == [at]
        assert secret_scan.calibrated(model, secret_scan.Network(model["weights"]).score(secret_scan.window(text, 4, at[2])[None]))[0] < model["threshold"]


def test_every_labelled_window_is_learned_from(spark, monkeypatch):
    monkeypatch.setattr(secret_scan, "BLOCK", 256)
    rows = [(None if i % 5 == 0 else i, t) for i, t in planted()[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = {(x, y) for r in secret_scan._labelled([pa.RecordBatch.from_arrays([pa.array([t for _, t in rows])], names=["text"])]) for x, y in zip(*(c.to_pylist() for c in r.columns))}
    blocks = secret_scan._blocks(docs).collect()
    cut = lambda x: [bytes(w) for w in secret_scan._unpacked(bytes(x))]
    learned = [(w, y) for b in blocks for y, x in ((1, b["good"]), (0, b["bad"])) for w in cut(x)]
    held = [(w, y) for b in blocks for y, x in ((1, b["held_good"]), (0, b["held_bad"])) for w in cut(x)]
    assert len(blocks) > 4 and len(held) == len(set(held)) and not set(held) & set(learned)
    assert set(held) | set(learned) == want
    one, two = secret_scan.train(docs), secret_scan.train(docs.repartition(3))
    assert one["threshold"] == two["threshold"] and all((a == b).all() for a, b in zip(one["weights"], two["weights"]))
