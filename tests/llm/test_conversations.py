import hashlib
import itertools
import random

from lexvane.llm.conversations import repair_conversations, repaired_messages, stand_ins

BLANK = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(BLANK)
        out.append(1 if not bare else 2 if (role, text) in seen else 0 if bare[-1] in ".!?" else 3)
        seen.add((role, text))
    return out


def legal(initials):
    rest = initials[1:] if initials.startswith("s") else initials
    return initials == "" or (len(rest) > 0 and rest == "ua" * (len(rest) // 2))


def brute(rows):
    """Every choice of edits and of at most two inserts at each place; the cheapest, of these the least audit."""
    bad, best = faults(rows), None
    inserts = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]
    places = [["D"] + ([] if f in (1, 2) else ["K"] * bool(role) + ["user", "assistant"]) for f, (role, _) in zip(bad, rows, strict=True)]
    for edits in itertools.product(*places):
        for holes in itertools.product(inserts, repeat=len(rows) + 1):
            cost, audit, said = 0, "", []
            for k in range(len(rows) + 1):
                for r in holes[k]:
                    cost, audit, said = cost + 5, audit + "I", [*said, (r, "")]
                if k == len(rows):
                    break
                role, text = rows[k]
                if edits[k] == "D":
                    cost, audit = cost + 2, audit + "D"
                else:
                    kept = edits[k] == "K"
                    cost, audit = cost + (0 if kept else 1) + (5 if bad[k] == 3 else 0), audit + ("K" if kept else "R")
                    said = [*said, (role if kept else edits[k], text)]
                if best and cost > best[0]:
                    break
            else:
                continue
            if legal("".join(r[:1] for r, _ in said)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, said)
    return best


def test_against_every_choice_of_edits(spark):
    rng, rows = random.Random(3), []
    for conv in range(120):
        for turn in range(rng.randrange(1, 4)):
            rows.append((conv, turn, rng.choice(["user", "user", "assistant", "system", "tool", "", "u"]), rng.choice(["a.", "b!", "c?\n", "d", " ", "", "e. f", "a."])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    found = repair_conversations(df)
    repaired: dict = {}
    for r in repaired_messages(df, found).collect():
        repaired.setdefault(r.conv_id, []).append((r.position, r.role, r.text))
    for r in found.collect():
        own = [x[2:] for x in sorted(x for x in rows if x[0] == r.conv_id)]
        cost, audit, said = brute(own)
        assert (r.cost, r.audit) == (cost, audit), own
        assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in said).encode()).hexdigest()
        assert [x[1:] for x in sorted(repaired.get(r.conv_id, []))] == said
        bad = faults(own)
        assert [r.blank, r.duplicate, r.truncated] == [bad.count(k) for k in (1, 2, 3)]
        assert r.illegal == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own)) and r.gaps == 0


def plain(rows):
    """The pass with whole audits, for conversations of any length."""
    bad = faults(rows)
    nxt = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})

    def close(layer):
        for _ in range(3):
            for s in range(4):
                for c, t in nxt[s].items():
                    if layer[s] and c != "s":
                        layer[t] = min([x for x in (layer[t], (layer[s][0] + 5, layer[s][1] + "I")) if x])
        return layer

    layer = close([(0, ""), None, None, None])
    for (role, _), f in zip(rows, bad, strict=True):
        new = [None] * 4
        for s in range(4):
            if layer[s]:
                c, a = layer[s]
                moves = [(s, c + 2, a + "D")]
                if f in (0, 3):
                    for letter, t in nxt[s].items():
                        moves += [(t, c + 5 * (f == 3), a + "K")] * (role[:1] == letter) + [(t, c + 1 + 5 * (f == 3), a + "R")] * (letter != "s")
                for t, cost, audit in moves:
                    new[t] = min([x for x in (new[t], (cost, audit)) if x])
        layer = close(new)
    return min(x for x in (layer[0], layer[3]) if x)


def test_long_conversations(spark):
    rng, rows = random.Random(4), []
    for conv, size in ((1, 3000), (2, 1200), (3, 700), (None, 900)):
        for turn in range(size):
            role = "user" if conv == 3 else rng.choice(["user", "assistant", "user", "assistant", "system"])
            rows.append((conv, 2 * turn, role, f"{turn} " + rng.choice(["x.", "y!", "z", " "])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    for r in repair_conversations(df).collect():
        own = [x[2:] for x in rows if x[0] == r.conv_id]
        assert (r.cost, r.audit) == plain(own)
        assert r.gaps == len(own) - 1


def test_stand_ins_compare_alike():
    rng = random.Random(5)
    for _ in range(2000):
        audits = ["".join(rng.choice("DIKR") for _ in range(rng.randrange(6))) for _ in range(rng.randrange(1, 5))]
        short = stand_ins(audits)
        for a, b in itertools.product(range(len(audits)), repeat=2):
            assert (audits[a] < audits[b]) == (short[a] < short[b]) and audits[b].startswith(audits[a]) == short[b].startswith(short[a])


def test_odd_rows(spark):
    rows = [
        (1, None, "user", "hi.", "x"), (1, 4, "assistant", "yes. ", "x"), (1, 4, "assistant", "yes. ", "x"), (1, 9, None, None, "x"),
        (None, 1, "system", "be short.", "x"), (None, 2, "user", "well", "x"), (2, None, "user", "long " * 50_000 + ".", "x"), (3, 5, "user", "", None),
    ]
    df = spark.createDataFrame(rows, "c long, audit long, role string, cost string, conv_id string")
    got = {r.c: r for r in repair_conversations(df, "c", "audit", "role", "cost").collect()}
    assert (got[1].gaps, got[1].blank, got[1].duplicate, got[1].illegal, got[1].audit, got[1].cost) == (4, 1, 1, 2, "KKDD", 4)
    assert (got[None].truncated, got[None].audit, got[None].gaps) == (1, "DD", 0)
    assert (got[2].audit, got[2].gaps, got[3].audit, got[3].blank) == ("D", 0, "D", 1)
    assert got[3].repaired_sha256 == hashlib.sha256(b"").hexdigest()
    assert repair_conversations(df.where("false"), "c", "audit", "role", "cost").count() == 0
