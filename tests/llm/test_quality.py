import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import quality
from tests.llm import data

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words = re.findall(WORD, text)
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text))}
    seen, duplicate = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            duplicate += line in seen
            seen.add(line)
    out["n_dup_lines"] = duplicate

    def inside(n):
        counts = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        return {j for i in range(len(words) - n + 1) if counts[tuple(words[i : i + n])] > 1 for j in range(i, i + n)}

    out["n_repeat_words"] = len(inside(3))
    for n in quality.MAX_COVER:
        out[f"cover_{n}"] = sum(len(words[j]) for j in inside(n)) / out["word_chars"] if words else 0.0
    out["base_failed"] = len(words) < 50 or 100 * out["n_repeat_words"] > 50 * len(words)
    return out


def agrees(text):
    got, want = quality.measure(text), brute(text)
    assert {k: got[k] for k in want if not k.startswith("cover")} == {k: v for k, v in want.items() if not k.startswith("cover")}
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want if k.startswith("cover"))
    assert not (got["base_failed"] and got["kept"])


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é#|\n\t \x85\x1c", max_size=120))
def test_measures_equal_brute_force(text):
    agrees(text)


def test_long_and_repeated_texts():
    agrees(data.text(1, 3000))
    agrees(" ".join([data.text(2, 30)] * 4))
    agrees("\n".join([data.text(3, 12)] * 3 + [data.text(4, 60)]))
    assert not quality.measure(" ".join([data.text(2, 60)] * 3))["kept"]
    assert quality.measure(" ".join(f"w{i}" for i in range(200)))["kept"]


def test_edges(spark):
    rows = data.edge_rows()
    got = quality.repetition(data.docs(spark, rows)).collect()
    assert len(got) == len(rows)
    want = [(d, brute(t)["n_words"]) for d, t, *_ in rows]
    assert Counter((r.doc_id, r.n_words) for r in got) == Counter(want)
    assert quality.repetition(data.docs(spark, [])).count() == 0


def test_filter_keeps_columns_and_clean_rows(spark):
    good = " ".join(f"word{i}" for i in range(100))
    docs = data.docs(spark, [(1, good), (2, "short"), (3, None), (4, good)])
    kept = quality.keep_clean(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4]
