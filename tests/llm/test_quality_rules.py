import random
import re
from collections import Counter

from loomgraph.llm import quality_rules


def expected(i, text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    twice = Counter(runs)
    covered = {k + j for k, r in enumerate(runs) if twice[r] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, chars, symbols = len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text))
    repeats = len(lines) - len(set(lines))
    failed = n < 10 or 100 * len(covered) > 20 * n
    capitals = sum(c.isupper() for c in text)
    kept = not (failed or chars < 2 * n or chars > 20 * n or 100 * symbols > 30 * n or 10 * repeats > 4 * len(lines) or 2 * capitals > chars)
    return (i, n, chars, symbols, repeats, len(covered), failed, kept)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_matches_brute_force(frame):
    rnd = random.Random(6)
    pieces = ["the", "of", "LOUD!!", "x###", "|", "\n", "same line here\n", "a b c d e ", "é日本🎉", "word", "longer", "\t", "z" * 30]
    rows = [(k, " ".join(rnd.choice(pieces[: rnd.randint(2, len(pieces))]) for _ in range(rnd.randint(0, 60)))) for k in range(300)]
    out = rows_of(quality_rules.apply_rules(frame(rows)))
    assert out == sorted((expected(*r) for r in rows), key=repr)
    assert any(r[-1] for r in out)


def test_odd_rows(frame, odd):
    from tests.llm.conftest import ODD

    assert rows_of(quality_rules.apply_rules(odd)) == sorted((expected(*r) for r in ODD), key=repr)
    assert quality_rules.apply_rules(frame([])).count() == 0


def test_order_changes_no_verdict(frame):
    rows = [(k, "word " * k + "# " * (k % 7)) for k in range(60)]
    docs = frame(rows)
    assert rows_of(quality_rules.apply_rules(docs)) == rows_of(quality_rules.apply_rules(docs, list(reversed(quality_rules.RULES))))
    ordered = quality_rules.cascade_order(docs, quality_rules.RULES)
    assert sorted(r.name for r in ordered) == sorted(r.name for r in quality_rules.RULES)


def test_order_is_by_rejection_per_cost(frame):
    docs = frame([(k, "word " * 20 + "# " * (30 * (k % 2)) + "ABCDEF " * (40 * (k % 4 == 0))) for k in range(80)])
    rules = [r for r in quality_rules.RULES if r.name in ("symbols", "shouting", "word_length")]

    def clock(costs):
        now = 0.0
        for cost in (1, *(1 + c for c in costs)):  # an idle pass, then the rules
            for _ in range(2):
                yield now
                now += cost
                yield now

    names = lambda *costs: [r.name for r in quality_rules.cascade_order(docs, rules, clock=clock(costs).__next__)]
    assert [r.name for r in rules] == ["word_length", "symbols", "shouting"]
    assert names(1, 9, 1)[0] == "shouting" and names(1, 1, 9)[0] == "symbols" and names(1, 1, 1)[-1] == "word_length"
