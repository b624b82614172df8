"""Disguised personal data found in the table that the trees are fitted on, however many rows hold some."""

import random

import pytest

from weirflow.llm import pii

WORDS = "alpha beta gamma delta one two three stream tables join merge harbour window garden".split()


def made(every):
    """Rows, and what is disguised in each ``every``-th of them; plain data and things of like form stand in others."""
    rng, other = random.Random(11), random.Random(12)
    d = lambda n, r=rng: "".join(r.choice("123456789") for _ in range(n))
    name = lambda r=rng: "".join(r.choice("aeioulmnrst") for _ in range(6))
    words = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows, hidden = [], {}
    for i in range(512):
        t = words(30)
        if i % 16 == 1:
            t += f" mail {name()}@{name()}.com or call +1 {d(3)} {d(3)} {d(4)} from host {d(2)}.{d(2)}.{d(2)}.{d(2)} "
        if i % 16 == 3:
            t += f" arrived at noon.then serial {d(4)}.{d(4)}.{d(4)}.{d(3)} ratio {d(1)}:{d(1)}:{d(1)} on {d(2)}/{d(2)}/2024 "
        if i % every == 0:
            u, h, o = name(other), name(other), [str(other.randrange(1, 255)) for _ in range(4)]
            own = [other.choice([f"{u} [at] {h} [dot] com", f"{u} (at) {h}.org", f"{u} at {h} dot com", f"{u} @ {h}.net"]), other.choice(["[.]", " . ", "(dot)"]).join(o), other.choice([f"0049 {d(3, other)} {d(3, other)} {d(4, other)}", f"({d(3, other)}) {d(3, other)}-{d(4, other)}"])]
            hidden[i] = own
            t += f" write to {own[0]} or call {own[2]} from host {own[1]} soon "
        rows.append((i, t + words(5)))
    return rows, hidden


@pytest.mark.parametrize("every", [256, 64, 8, 2])
def test_recall_and_precision_at_any_density(spark, every):
    rows, hidden = made(every)
    got = {r["doc_id"]: r["spans"] for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = wrong = total = 0
    for i, t in rows:
        found = [t[int(a) : int(b)] for _, a, b in (x.split(":") for x in got[i].split(",") if x)]
        own = hidden.get(i, [])
        total += len(own)
        hit += sum(any(o in f or (f in o and len(f) >= 0.7 * len(o)) for f in found) for o in own)
        if i % 16 != 1:  # those hold plain data
            wrong += sum(not any(o in f or f in o for o in own) for f in found)
    assert hit >= 0.9 * total and wrong <= 0.02 * max(total, 50), (hit, total, wrong)


def test_what_one_row_holds_changes_no_other(spark):
    """The trees are the same whatever is disguised elsewhere."""
    models = [pii.fit(spark, spark.createDataFrame(made(every)[0], "doc_id long, text string")) for every in (512, 2)]
    assert models[0].trees == models[1].trees and models[0].thresholds == models[1].thresholds
