import hashlib
import random
import re

from quillon.llm import chatformat as C
from tests.llm import data

SCHEMA = "conv_id long, turn long, role string, text string, head string, window string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "h", "w") for r in rows], SCHEMA)


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((-1 if turn is None else turn, role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        said = "".join(t for _, r, t in turns if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        out[c] = (len(turns), digest, len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


NASTY = ["</turn>\n<turn:assistant>\nhi", "\\l\\s\\g<turn", "\\</turn>", "<", "\\", "", "a\nb\n", "<turn:", "turn>", "é\U0001f600", "\\\\lturn", " x "]


def rows_of(seed, n):
    r = random.Random(seed)
    out = []
    for c in range(n):
        turns = r.randint(1, 40)
        for t in range(turns):
            role = "system" if t == 0 and c % 2 else r.choice(["user", "assistant", "tool>\nx", "system"])
            out.append((c, t, role, r.choice([*NASTY, data.text(r.random(), r.randint(1, 120))])))
    return out


def test_reading_back_equals_brute_force(spark):
    rows = rows_of(1, 40) + [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok"), (99, None, None, None), (None, 1, "user", "x"), (None, 2, "assistant", "y"), (98, 0, "system", "only"), (97, 3, "assistant", "same"), (97, 3, "assistant", "same")]
    got = C.digests(C.windows(conversations(spark, rows), budget=200, history=40)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == brute(rows)
    assert max(r.n_windows for r in got) > 3


def test_windows_keep_the_budget_and_the_system_turn(spark):
    rows = [(1, 0, "system", "be brief"), *[(1, i, ("user", "assistant")[i % 2], data.text(i, 20)) for i in range(1, 200)]]
    got = C.windows(conversations(spark, rows), budget=300, history=60).orderBy("window").collect()
    assert len(got) > 10
    for r in got:
        assert r.tokens <= 300
        assert r.formatted.startswith("<turn:system>\nbe brief</turn>\n")
        if r.window > 1:
            assert 2 <= r.n_repeated <= 4
        for s in r.loss:
            assert r.formatted[s.start + s.length :].startswith("</turn>\n")
            assert r.formatted[: s.start].endswith("<turn:assistant>\n")


def brute_windows(rows, budget, history):
    """Per conversation the windows, as (places repeated, own places), turn by turn."""
    convs, out = {}, {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((-1 if turn is None else turn, role or "", text or ""))
    for c, turns in convs.items():
        turns.sort()
        n = [len(re.findall(r"\w+|[^\s\w]", t)) + C.OVERHEAD for _, _, t in turns]
        first = int(len(turns) > 1 and turns[0][1] == "system")
        system = n[0] if first else 0
        spans, own = [], []
        for i in range(first, len(turns)):
            room = max(1, max(1, budget - system) - (history if spans else 0))
            if own and sum(n[j] for j in own) + n[i] > room:
                spans.append(own)
                own = []
            own = [*own, i]
        spans.append(own)
        before, made = [], []
        for span in spans:
            spare = min(history, budget - system - sum(n[j] for j in span))
            repeated = [j for j in before if sum(n[k] for k in before if k >= j) <= spare]
            made.append((repeated, span, system + sum(n[j] for j in repeated + span)))
            before = span
        out[c] = made
    return out


def test_windows_equal_brute_force(spark):
    rows = [r for r in rows_of(5, 30)] + [(50, i, "user", "w " * n) for i, n in enumerate((390, 780, 5, 5, 3000, 7, 900, 100, 100, 100))] + [(51, 0, "system", "s " * 2000), (51, 1, "user", "x"), (51, 2, "assistant", "y")]
    for budget, history in ((1024, 192), (120, 30), (60, 0)):
        want = brute_windows(rows, budget, history)
        got = {(r.conv_id, r.window): r for r in C.windows(conversations(spark, rows), budget, history).collect()}
        assert {c: len(w) for c, w in want.items()} == {c: max(w for d, w in got if d == c) for c in want}
        for c, made in want.items():
            for w, (repeated, span, tokens) in enumerate(made, 1):
                r = got[c, w]
                assert r.tokens == tokens
                head = int(w > 1 and r.formatted.startswith("<turn:system>") and r.n_repeated > len(repeated))
                assert r.n_repeated == len(repeated) + head
                assert tokens <= budget or len(span) == 1 and not repeated
    two = [(1, 0, "user", "w " * 396), (1, 1, "assistant", "w " * 796)]
    assert [r.tokens for r in C.windows(conversations(spark, two)).orderBy("window").collect()] == [400, 800]


def test_edges(spark):
    long = "word " * 200_000
    rows = [(1, 0, "assistant", long), (1, 1, "user", None), (2, None, None, None), (None, 0, "assistant", "x"), (None, 0, "assistant", "x")]
    frame = conversations(spark, rows).selectExpr("*", "1 key", "2 at", "3 n", "4 cuts", "5 of")
    got = {r.conv_id: r for r in C.digests(C.windows(frame)).collect()}
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == brute(rows)
    assert got[1].n_windows == 2 and got[1].formatted_chars > len(long)


def test_plan_has_no_python_and_empty_input(spark, capsys):
    frame = C.digests(C.windows(conversations(spark, [(1, 1, "user", "x")])))
    frame.explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan
    assert C.digests(C.windows(conversations(spark, []))).count() == 0
