import itertools
import random

from dunlin.llm import chat as C


def cheapest(roles):
    codes, best = [C.code(r) for r in roles], None
    for labels in itertools.product((1, 2, 3), repeat=len(codes)):
        p, cost = 0, 0
        for q, r in zip(labels, codes):
            cost += C.move(p, q, r)
            p = q
        cost += C.INSERT * len(C.END[p])
        best = cost if best is None else min(best, cost)
    return best


def legal(roles):
    want = roles[1:] if roles[:1] == ["system"] else roles
    return len(want) % 2 == 0 and all(r == ("user", "assistant")[k % 2] for k, r in enumerate(want))


def test_repairs_are_cheapest_and_legal():
    rnd = random.Random(2)
    for _ in range(300):
        roles = [rnd.choice(["user", "assistant", "system", "human", None, "?"]) for _ in range(rnd.randint(1, 6))]
        codes = [C.code(r) for r in roles]
        end = C.forward(C.BEGIN, codes)[-1]
        last = C.closing(end)
        assert end[last] + C.INSERT * len(C.END[last]) == cheapest(roles)
        final = []
        for role, action, inserted in C.repair(roles):
            final += list(inserted)
            if action != "merge":
                final.append(role)
        final += [C.STATES[x] for x in C.END[last]]
        assert legal(final)


def rows_of(seed):
    rnd = random.Random(seed)
    rows = []
    for c in [*range(20), None]:
        for t in range(rnd.choice([1, 2, 3, 6]) if c != 7 else 300):
            rows.append((c, t if c != 3 else None, rnd.choice(["user", "assistant", "system", "GPT", None, "x"]), rnd.choice([f"t{c}.{t}", None, ""]), "extra"))
    return rows + rows[:3]


def test_parts_do_not_matter(spark):
    df = spark.createDataFrame(rows_of(1), "conv_id long, turn int, role string, text string, part string")
    whole = C.format_chats(df, rows=10**6).orderBy("ord").collect()
    for rows in (7, 25, 90):
        cut = C.format_chats(df, rows=rows).orderBy("ord").collect()
        strip = lambda out: [tuple(r[c] for c in ("conv_id", "turn", "role", "new_role", "action", "rendered")) for r in out]
        assert strip(cut) == strip(whole)
    for _, turns in itertools.groupby(whole, key=lambda r: r.conv_id):
        text = "".join(t.rendered for t in turns)
        roles = [p.split("|>")[0] for p in text.split("<|")[1:] if not p.startswith("end")]
        assert legal(roles) and text.count("<|end|>") == len(roles) and text.endswith("<|end|>\n")


def test_kept_as_is_and_empty(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", "b")]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    out = C.format_chats(df).orderBy("ord").collect()
    assert [r.action for r in out] == ["keep"] * 3
    assert "".join(r.rendered for r in out) == "<|system|>\ns<|end|>\n<|user|>\na<|end|>\n<|assistant|>\nb<|end|>\n"
    assert C.format_chats(df.limit(0)).count() == 0
