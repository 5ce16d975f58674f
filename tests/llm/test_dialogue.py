"""Conversation repair against dynamic programming over costs and letters at once."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import pytest

from tracewell.llm import dialogue, queries

SCHEMA = "conv_id long, turn long, role string, text string, key string, pos int, audit string"
SPACE = " \t\n\u000b\f\r"


def brute(codes: str) -> tuple[int, str]:
    """The cheapest edits of least letters that make ``(s?(ua)+)?``, by relaxation from the end."""
    n, after = len(codes) // 2, {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
    best: dict[tuple[int, int], tuple[int, str]] = {(n, 0): (0, ""), (n, 3): (0, "")}

    def offer(node, found) -> bool:
        if found < best.get(node, (10**9, "")):
            best[node] = found
            return True
        return False

    for k in range(n, -1, -1):
        if k < n:
            initial, fault = codes[2 * k], codes[2 * k + 1]
            for q in range(4):
                moves = [("D", 3, q)]
                if fault not in "bd":
                    more, (role, to) = int(fault == "t"), after[q]
                    moves.append(("R", 2 + more, to))
                    if initial == role:
                        moves.append(("K", more, to))
                    if initial == "s" and q == 0:
                        moves.append(("K", more, 1))
                for letter, cost, to in moves:
                    if (k + 1, to) in best:
                        c, s = best[k + 1, to]
                        offer((k, q), (c + cost, letter + s))
        changed = True
        while changed:
            changed = False
            for q in range(4):
                to = after[q][1]
                if (k, to) in best:
                    c, s = best[k, to]
                    changed |= offer((k, q), (c + 2, "I" + s))
    return best[0, 0]


def brute_rows(rows: list[tuple]) -> tuple:
    """The contract's row for a conversation's damaged rows in order."""
    seen, codes, counts, roles = set(), "", {"b": 0, "d": 0, "t": 0, "-": 0}, []
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        fault = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-"
        seen.add((role, text))
        counts[fault] += 1
        roles.append(role[:1])
        codes += (role[:1] if role[:1] in ("s", "u", "a") else "x") + fault
    cost, audit = brute(codes)
    lines, at, state = [], iter(rows), "start"
    for edit in audit:
        _, role, text = ("", "", "") if edit == "I" else next(at)
        if edit == "D":
            continue
        if edit in "IR":
            role = "assistant" if state == "u" else "user"
        lines.append(f"{role}:{text if edit != 'I' else ''}")
        state = role[:1]
    turns = {t for t, *_ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(roles))
    return gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def brute_damage(rows: list[tuple]) -> dict:
    out: dict = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        said = lambda v: " " if v is None else str(v)
        kind, role, text = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20, said(role), said(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for kept in out.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
    return out


def conversations() -> list[tuple]:
    rng = random.Random(11)
    rows = []
    for conv in range(150):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"])
            rows.append((conv, turn + conv * (conv % 3 == 0), role, rng.choice(["Yes.", "No", "What? ", " \t", None, "Ñ!", f"word {rng.random()}."])))
    for conv, n in ((900, 700), (901, 130), (902, 65)):  # cut into fragments
        rows += [(conv, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Same.", f"{t}.", f"{t}", " "])) for t in range(n)]
    rows += [(903, t, "user", "Copy.") for t in range(200)]
    rows += [(904, 5, "user", "x." * 60_000), (904, 5, "user", "x." * 60_000), (905, None, "user", "Hi."), (905, None, "assistant", "Ho."), (905, 3, "user", "?"), (None, 1, "user", "Hm."), (None, None, None, None)]
    return rows


def test_query_follows_its_contract(spark, tmp_path):
    rows = conversations()
    rng = random.Random(1)
    rng.shuffle(rows)
    spark.createDataFrame([(*r, "k", 7, "a") for r in rows], SCHEMA).repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    want = {conv: brute_rows(kept) for conv, kept in brute_damage(rows).items()}
    found = queries.op11_conversations(spark, str(tmp_path)).collect()
    got = {r.conv_id: tuple(r)[1:] for r in found}
    assert len(found) == len(got) and got.keys() == want.keys()
    assert {c for c in want if got[c] != want[c]} == set()
    assert any(not r.audit and r.cost == 0 for r in found) and {"D", "I", "K", "R"} <= set("".join(r.audit for r in found))


def test_every_short_sequence_has_the_cheapest_edits_of_least_letters():
    codes = ["s-", "u-", "a-", "x-", "ut", "at", "ub", "ad"]
    for n in range(5):
        for rows in itertools.product(codes, repeat=n):
            text = "".join(rows)
            assert dialogue.edits(text, dialogue.END, True, (0,))[0][0] == brute(text)[1], text


def test_prices_are_the_least_costs():
    rng = random.Random(5)
    for _ in range(60):
        text = "".join(rng.choice("suax") + rng.choice("----tbd") for _ in range(rng.randrange(1, 40)))
        lattice = dialogue.Lattice(text, dialogue.END, True)
        assert lattice.auction(0) == brute(text)[0]
        assert all(lattice.price[i] <= cost + lattice.price[j] for i in range(lattice.end) for _, cost, j in lattice.arcs[i])


@pytest.mark.parametrize("repeat", [1, 3])
def test_repaired_turns_read_as_pairs(spark, repeat):
    rows = [r for r in conversations() for _ in range(repeat)]
    df = spark.createDataFrame([(*r, "k", 7, "a") for r in rows], SCHEMA).repartition(3)
    digests = {r.conv_id: r.repaired_sha256 for r in dialogue.audit_conversations(df).collect()}
    turns: dict = {}
    for r in dialogue.repaired(df).collect():
        turns.setdefault(r.conv_id, []).append((r["at"], r.role, r.text))
    for conv, digest in digests.items():
        kept = [t[1:] for t in sorted(turns.get(conv, []))]
        initials = "".join(role[:1] for role, _ in kept)
        pairs = initials[1:] if initials[:1] == "s" else initials
        assert pairs == "ua" * (len(pairs) // 2) and (pairs or not initials)
        assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in kept).encode()).hexdigest() == digest


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert dialogue.audit_conversations(dialogue.damage(empty), empty).collect() == [] and dialogue.repaired(empty).collect() == []
