import json
import re

import pytest
from conftest_data import DATA
from odd import check_types, docs, no_docs, odd_docs, odd_rows, prose
from pyspark.sql import functions as F

from sluice.llm import line_dedup, queries, tool_calls, url_filter
from sluice.llm.common import read


def brute_lines(rows, least):
    """doc_id -> kept text, by going through all lines in rank order."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        left = []
        for line in re.findall(r"[^\n]*\n|[^\n]+$", text or ""):
            words = re.sub(r"[\W_]+", " ", line.lower()).split()
            if len(words) >= least and tuple(words) in seen:
                continue
            if len(words) >= least:
                seen.add(tuple(words))
            left.append(line)
        out[i] = "".join(left)
    return out


def test_lines_by_brute_force(spark):
    lines = [prose(k, 8 + k) for k in range(6)] + ["short line", prose(2, 10).upper() + "!!"]
    rows = [(i, "\n".join(lines[(i * j) % len(lines)] for j in range(1, 5)) + ("\n" if i % 2 else "")) for i in range(1, 30)]
    result = line_dedup.dedup_lines(docs(spark, [(i, t, "en", "a") for i, t in rows]))
    got = {r.doc_id: r for r in result.collect()}
    assert {i: r.kept_text for i, r in got.items()} == brute_lines(rows, line_dedup.MIN_WORDS)
    texts = dict(rows)
    for i, r in got.items():
        gone = "".join(texts[i][s.start : s.end] for s in r.removed)
        assert len(gone) == r.removed_chars and r.changed == bool(gone)
        for s in r.removed:
            first = re.sub(r"\W+", " ", texts[s.kept_doc_id][s.kept_start :].split("\n")[0].lower()).split()
            assert first == re.sub(r"\W+", " ", texts[i][s.start : s.end].lower()).split()


def test_short_lines_and_passages(spark):
    """Repeats below ten words go too, as do lines without spaces or words, and passages whose lines are broken elsewhere."""
    words = [f"w{k}" for k in range(54)]
    passage = ["\n".join(" ".join(words[k : k + n]) for k in range(0, 54, n)) for n in (9, 6, 54)]
    texts = {
        1: f"Subscribe now!\n这是一个重复的句子。\n* * *\n\n{passage[0]}\n\nlast of one",
        2: "subscribe now\n这是一个重复的句子\n***\n* * *\n\nonly in two",
        3: f"own\n\n{passage[1]}\n\n{passage[2]}\n\nend",
        4: f"{passage[0]}\nw0 w1",
        5: "own end\n\nOwn\nEnd",
        6: "w0 w1\nmore",
    }
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, [(i, t, "en", "a") for i, t in texts.items()])).collect()}
    assert {i: r.kept_text for i, r in got.items()} == {
        1: texts[1],
        2: "***\n\nonly in two",
        3: "own\n\n\n\nend",
        4: "w0 w1",
        5: "own end\n\n",
        6: "more",
    }
    at = texts[1].index("w0")
    assert [(s.kept_doc_id, s.kept_start) for s in got[3].removed] == [(1, at), (1, at)]
    assert [texts[4][s.start : s.end] for s in got[4].removed] == [line + "\n" for line in passage[0].split("\n")]
    for i, r in got.items():
        assert r.removed_chars == len(texts[i]) - len(r.kept_text) and r.changed == bool(r.removed)


def test_lines_of_the_table_by_brute_force(spark):
    """Over the whole table: every line and paragraph that stands at an earlier place is cut, and nothing else."""
    table = read(spark, DATA, "documents").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in table.collect()}
    seen, cut = set(), {}
    for i, text in sorted(texts.items()):
        found = []
        for block in re.finditer(r"(?:[^\n]*\S[^\n]*(?:\n|$))+", text):
            lines = [(m.start() + block.start(), m.end() + block.start()) for m in re.finditer(r"[^\n]*\n|[^\n]+$", block.group())]
            words = [re.sub(r"[\W_]+", " ", text[a:b].lower()).split() for a, b in lines]
            if len(lines) > 1:
                found.append((lines[0][0], sum((w or text[a:b].split() for w, (a, b) in zip(words, lines, strict=True)), []), lines[-1][1]))
            found += [(a, w or text[a:b].split(), b) for w, (a, b) in zip(words, lines, strict=True)]
        gone = cut.setdefault(i, bytearray(len(text)))
        for a, words, b in sorted(found, key=lambda f: (f[0], -f[2])):
            if tuple(words) in seen:
                gone[a:b] = b"\x01" * (b - a)
            seen.add(tuple(words))
    got = {r.doc_id: r.kept_text or "" for r in line_dedup.dedup_lines(table).collect()}
    assert got == {i: "".join(c for c, g in zip(t, cut[i], strict=True) if not g) for i, t in texts.items()}


def test_lines_of_odd_rows(spark):
    got = line_dedup.dedup_lines(odd_docs(spark)).collect()
    assert len(got) == len(odd_rows())
    assert {r.doc_id for r in got if r.changed} == {5, 6}
    assert sum(r.changed for r in got) == 3
    assert next(r for r in got if r.doc_id == 1).kept_text is None
    assert line_dedup.dedup_lines(no_docs(spark)).count() == 0


def brute_passages(texts, least=50):
    """doc_id -> the words that stay, by going through every run of words in rank order."""
    seen, out = set(), {}
    for i, text in sorted(texts.items()):
        words = re.findall(r"[^\W_]+", (text or "").lower())
        gone = [False] * len(words)
        for k in range(len(words) - least + 1):
            run = tuple(words[k : k + least])
            if run in seen:
                gone[k : k + least] = [True] * least
            seen.add(run)
        out[i] = [w for w, g in zip(words, gone, strict=True) if not g]
    return out


def test_passages_wherever_they_stand(spark):
    """Passages inside lines, with other line breaks, case and marks; of 50 words but not of 49; in and over one text."""
    a, b, c = (prose(k, n) for k, n in ((1, 60), (2, 50), (4, 49)))
    texts = {
        1: f"One begins {a} and ends. {c} One.\nAll rights reserved.",
        2: f"Two is {a.upper().replace(' ', ',\n')}! (Then) {b} two ends",
        3: f"{c} three\n\n{b}, {prose(11, 70)}.\n\nlast\nAll rights reserved.",
        4: "the " * 300 + "end",
        5: f"{' '.join(a.split()[30:])} {b} five " + "x y z. " * 40,
        6: "nothing in six\nAll rights reserved.",
        7: b,
        8: None,
        9: prose(11, 70) + " 这是" + "一二三四五六七八九十" * 6,
        10: "前" + "一二三四五六七八九十" * 5 + "后",
    }
    got = {r.doc_id: r for r in line_dedup.dedup_passages(docs(spark, [(i, t, "en", "a") for i, t in texts.items()])).collect()}
    left = {i: re.findall(r"[^\W_]+", (r.kept_text or "").lower()) for i, r in got.items()}
    want = brute_passages({i: t for i, t in texts.items() if i < 9})
    assert {i: w for i, w in left.items() if i < 9} == want
    assert [got[i].kept_text for i in (1, 2, 6, 7, 8, 10)] == [texts[1], "Two is (Then) two ends".replace(" two", f" {b} two"), texts[6], "", None, "前后"]
    assert got[9].kept_text == "这是一二三四五六七八九十"
    for i, r in got.items():
        assert r.changed == bool(r.removed) == (r.kept_text != texts[i])
        assert r.removed_chars == sum(s.end - s.start for s in r.removed) == len(texts[i] or "") - len(r.kept_text or "")
        assert all(x.end <= y.start for x, y in zip(r.removed, r.removed[1:], strict=False))
    assert [(s.kept_doc_id, s.kept_start) for s in got[2].removed] == [(1, texts[1].index(a))]
    assert [(s.kept_doc_id, s.kept_start) for s in got[7].removed] == [(2, texts[2].index(b))]
    assert [[texts[i][s.start : s.end] for s in got[i].repeated_lines] for i in (3, 6)] == [["All rights reserved."]] * 2


def test_passages_of_odd_rows(spark):
    got = line_dedup.dedup_passages(odd_docs(spark)).collect()
    assert len(got) == len(odd_rows())
    assert sorted((r.doc_id, r.kept_text) for r in got if r.changed and r.doc_id != 9) == [(5, ""), (5, ""), (6, "")]
    long = next(r for r in got if r.doc_id == 9)  # its words come round after a while
    assert long.kept_text.split() == brute_passages({9: prose(9, 30_000)})[9]
    assert next(r for r in got if r.doc_id == 1).kept_text is None
    assert line_dedup.dedup_passages(no_docs(spark)).count() == 0


def test_passages_of_the_table_by_brute_force(spark):
    """The registered query cuts every word of a repeated run of 50 words and no other word."""
    texts = {r.doc_id: r.text for r in read(spark, DATA, "documents").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in queries.op2_line_dedup(spark, DATA).collect()}
    want = brute_passages(texts)
    assert {i: re.findall(r"[^\W_]+", (r.kept_text or "").lower()) for i, r in got.items()} == want
    assert {i for i, r in got.items() if r.changed} == {i for i, t in texts.items() if len(want[i]) < len(re.findall(r"[^\W_]+", t or ""))}


URLS = {
    1: ("https://WWW.Example.com/en/a?x", "www.example.com", "/en/a", "www.example.com/en/", "allow"),
    2: ("http://a.example.com/en/#t", "a.example.com", "/en/", "example.com/en/", "block"),
    3: ("http://example.com/EN/", "example.com", "/EN/", "com/", "allow"),
    4: ("https://b.net/fr/1", "b.net", "/fr/1", "net/fr/", "block"),
    5: ("https://notnet/fr/1", "notnet", "/fr/1", None, None),
    6: ("https://x.com", "x.com", "", None, None),
    7: ("x.com/en", "", "", None, None),
    8: (None, "", "", None, None),
    9: ("a://b.net?u=c://d.com/", "b.net", "", None, None),
    10: ("http://É.COM/\n/x", "É.com", "/\n/x", "com/", "allow"),
    11: ("", "", "", None, None),
    12: ("http://com/", "com", "/", "com/", "allow"),
}


def test_rules(spark):
    rows = spark.createDataFrame([(i, u[0], "h", "p", "r") for i, u in URLS.items()], "page_id long, url string, host string, path string, f string")
    result = url_filter.judge(rows)
    check_types(result, page_id="LongType", host="StringType", path="StringType", rule="StringType", verdict="StringType")
    for r in result.collect():
        _, host, path, rule, verdict = URLS[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.block_probability >= 0.5 else "allow"))
    assert url_filter.judge(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        url_filter.judge(rows, rules=[("allow", f"{i}.com/") for i in range(url_filter.MAX_RULES + 1)])


def test_the_model_learns_its_table(spark):
    known = [(i, r.url, r.blocked == 1.0) for i, r in enumerate(url_filter.labelled_urls(spark).collect())]
    rows = spark.createDataFrame(known, "page_id long, url string, blocked boolean")
    got = {r.page_id: r for r in url_filter.judge(rows, rules=[]).collect()}
    wrong = [u for i, u, blocked in known if (got[i].verdict == "block") != blocked]
    assert len(wrong) <= 0.02 * len(known), wrong


#: Names in the hosts of ``pages`` that are to be blocked; all its other names are clean.
SPAM = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def test_unseen_hosts_are_told(spark):
    """No host of the table is learnt from; of those with a spam name nearly all are blocked, and hardly another."""
    pages = read(spark, DATA, "pages").where("url like '%://%'")
    name = F.regexp_extract("host", r"^(?:(?:www|blog|m)\.)?(.*)\.example\.", 1)
    got = url_filter.judge(pages, rules=[]).select(name.alias("name"), "verdict").collect()
    assert not {r.name for r in got} & {*url_filter.BLOCKED_NAMES, *url_filter.ALLOWED_NAMES}
    spam = [r.verdict == "block" for r in got if r.name in SPAM]
    clean = [r.verdict == "block" for r in got if r.name not in SPAM]
    assert sum(spam) >= 0.95 * len(spam) > 0 and sum(clean) <= 0.02 * len(clean)


def test_long_and_repeated_urls(spark):
    long = "http://x.example.com/" + "a/b" * 100_000
    rows = spark.createDataFrame([(1, long), (1, long), (None, long), (2, "http://x.example.com/")], "page_id long, url string")
    got = url_filter.judge(rows, rules=[]).collect()
    assert sorted((str(r.page_id), len(r.path)) for r in got) == [("1", 300_001), ("1", 300_001), ("2", 1), ("None", 300_001)]
    assert len({r.block_probability for r in got if r.page_id != 2}) == 1


def test_the_model_by_brute_force(spark):
    """The dual form gives what gradient descent on the weights themselves gives."""
    labelled = url_filter.labelled_urls(spark).limit(60)
    host, path = url_filter.host_and_path(F.col("url"))
    rows = labelled.select("url", "blocked", url_filter.features(host, path).alias("f")).collect()
    weights, bias = url_filter.fit(labelled, rounds=50, decay=0.001)
    w, b = {}, 0.0
    for _ in range(50):
        zs = [b + sum(w.get(j, 0.0) for j in r.f) / len(r.f) ** 0.5 for r in rows]
        errors = [(1 / (1 + 2.718281828459045 ** -z) - r.blocked) * 8 / len(rows) for z, r in zip(zs, rows, strict=True)]
        w = {j: v * (1 - 0.001) for j, v in w.items()}
        b = b * (1 - 0.001) - sum(errors)
        for e, r in zip(errors, rows, strict=True):
            for j in r.f:
                w[j] = w.get(j, 0.0) - e / len(r.f) ** 0.5
    assert bias == pytest.approx(b)
    assert {j: v for j, v in enumerate(weights) if v} == pytest.approx(w)
    assert url_filter.fit(labelled.limit(0)) == ([0.0] * url_filter.BUCKETS, 0.0)


TOOLS = {"find": (("text", "STRING", True), ("n", "BIGINT", False)), "sum": ()}
CALLS = "conv_id long, call_id string, turn long, tool string, arguments string, needs array<string>, step string"


def linked(spark, calls, results):
    found = tool_calls.link(
        spark.createDataFrame([(*c, "x") for c in calls], CALLS), spark.createDataFrame(results, "conv_id long, call_id string, content string"), TOOLS
    )
    return {(r.conv_id, r.call_id): r for r in found.collect()}


def test_calls_and_results_meet(spark):
    got = linked(
        spark,
        [
            (1, "a", 0, "find", '{"text":"x", "n": 2}', []),
            (1, "b", 1, "find", '{"n":"two","text":"x"}', ["a"]),
            (1, "c", 2, "find", '{"n":1}', ["a", "gone"]),
            (1, "d", 3, "find", "[1]", None),
            (1, "e", 4, "find", "{bad", None),
            (1, "f", 5, "sum", '{"z":1}', None),
            (1, "g", 6, "other", "{}", None),
            (1, "h", 7, None, None, None),
            (2, "a", None, "sum", '{ }', None),
            (None, "a", 0, "sum", "{}", None),
            (1, None, 0, "sum", "{}", None),
            (1, "a", 9, "find", '{"text":"again"}', []),
        ],
        [(1, "a", "é\n"), (1, "a", "été"), (3, "a", None), (2, "z", "lost"), (None, "a", "x")],
    )
    assert {k: (r.step, r.status, r.error) for k, r in got.items()} == {
        (1, "a"): (0, "ok", None),
        (1, "b"): (1, "invalid", "n is not BIGINT"),
        (1, "c"): (2, "invalid", "text is missing"),
        (1, "d"): (3, "invalid", "arguments are not an object"),
        (1, "e"): (4, "invalid", "arguments are not JSON"),
        (1, "f"): (5, "invalid", "unknown argument z"),
        (1, "g"): (6, "invalid", "unknown tool"),
        (1, "h"): (7, "invalid", "unknown tool"),
        (2, "a"): (0, "no_result", None),
        (3, "a"): (None, "no_call", None),
        (2, "z"): (None, "no_call", None),
    }
    assert got[1, "a"].message == '{"arguments":{"n":2,"text":"x"},"id":"a","result":"é\\n","tool":"find"}'
    assert json.loads(got[2, "z"].message) == {"id": "z", "result": "lost"}


def test_order_respects_needs(spark):
    calls = [(1, "a", 0, "sum", "{}", ["d"]), (1, "b", 1, "sum", "{}", ["a"]), (1, "c", 2, "sum", "{}", []), (1, "d", 3, "sum", "{}", ["c"]), (1, "e", 4, "sum", "{}", ["b"])]
    got = linked(spark, calls, [])
    steps = {c: got[1, c].step for c in "abcde"}
    assert sorted(steps.values()) == [0, 1, 2, 3, 4]
    for _, c, _, _, _, needs in calls:
        assert all(steps[n] < steps[c] for n in needs)


def test_calls_that_need_each_other(spark):
    got = linked(spark, [(1, "a", 0, "sum", "{}", ["b"]), (1, "b", 1, "sum", "{}", ["a"]), (2, "a", 0, "sum", "{}", [])], [])
    assert {k: r.status for k, r in got.items()} == {(1, "a"): "loop", (1, "b"): "loop", (2, "a"): "no_result"}


def test_long_chains_are_no_loops_and_long_loops_are(spark, monkeypatch):
    """Chains of forward references longer than any number of rounds once allowed, beside loops of 2, 39 and 60 calls."""
    monkeypatch.setattr(tool_calls, "BUCKET_TURNS", 7)
    needs = {(1, i): [i + 1] for i in range(41)} | {(1, 41): []} | {(2, i): [i + 1] for i in range(25)} | {(2, 25): []}
    needs |= {(conv, i): [(i + 1) % n] for conv, n in ((3, 2), (4, 39), (5, 60)) for i in range(n)}
    needs |= {(3, 5): [0], (3, 6): [5], (3, 7): [], (3, 8): [9], (3, 9): [7], (6, 0): [0], (6, 1): []}
    got = linked(spark, [(conv, f"c{i}", i, "sum", "{}", [f"c{k}" for k in on]) for (conv, i), on in needs.items()], [])
    loops = {(conv, i) for conv, i in needs if conv in (4, 5)} | {(3, i) for i in (0, 1, 5, 6)} | {(6, 0)}
    assert {(r.conv_id, int(r.call_id[1:])) for r in got.values() if r.status == "loop"} == loops
    assert all(r.status in ("loop", "no_result") for r in got.values())
    for (conv, i), on in needs.items():
        assert (conv, i) in loops or all(got[conv, f"c{k}"].step < got[conv, f"c{i}"].step for k in on)
    for conv in range(1, 7):
        steps = sorted(r.step for r in got.values() if r.conv_id == conv)
        assert steps == list(range(len(steps)))


def test_a_long_conversation_is_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(tool_calls, "BUCKET_TURNS", 7)
    got = linked(spark, [(1, f"c{i}", i, "sum", "{}", [f"c{i - 1}"]) for i in range(60)], [])
    assert all(got[1, f"c{i}"].step == i for i in range(60))


def test_turns_that_are_no_calls(spark):
    """The rule of chat_calls for other roles, nulls and repeated turns."""
    rows = [
        (1, 0, "system", "s"),
        (1, 1, "user", "b"),
        (1, 1, "user", "a"),
        (1, 2, "assistant", "y"),
        (1, 2, "assistant", "x"),
        (1, 3, "tool", "t"),
        (1, 4, None, "n"),
        (1, None, "user", "no turn"),
        (1, None, "assistant", "no turn"),
        (None, 0, "user", "no conversation"),
    ]
    chat = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.call_id): r for r in tool_calls.link(*tool_calls.chat_calls(chat), tool_calls.CHAT_TOOLS).collect()}
    assert {k: (r.step, r.status) for k, r in got.items()} == {(1, "call_0"): (0, "no_result"), (1, "call_1"): (1, "invalid")}
    assert json.loads(got[1, "call_1"].message) == {"arguments": {"text": "a", "words": "1"}, "id": "call_1", "result": "x", "tool": "ask"}


def test_calls_made_from_chat(spark):
    """All that link tells occurs in the calls made of chat: references forward, loops and wrong arguments."""
    texts = {1: 4, 3: 7, 5: 8, 7: 5, 9: 3, 11: 9, 13: 10, 15: 11}
    rows = [(1, 0, "system", "s"), *[(1, t, "user", "w " * n) for t, n in texts.items()], *[(1, t + 1, "assistant", "r") for t in texts], (1, 40, "assistant", "x")]
    chat = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.call_id: r for r in tool_calls.link(*tool_calls.chat_calls(chat), tool_calls.CHAT_TOOLS).collect()}
    assert {k: (r.status, r.error) for k, r in got.items()} == {
        "call_0": ("no_result", None),
        "call_1": ("ok", None),
        "call_3": ("ok", None),
        "call_5": ("loop", None),
        "call_7": ("loop", None),
        "call_9": ("ok", None),
        "call_11": ("invalid", "words is missing"),
        "call_13": ("invalid", "words is not BIGINT"),
        "call_15": ("invalid", "unknown argument note"),
        "call_39": ("no_call", None),
    }
    assert got["call_3"].step == 1 and got["call_1"].step == 2  # the first question waits for the next


def test_integers_however_written(spark):
    given = ("1", "1.0", "1e2", "1.5", "1e-2", '"1"', "null")
    got = linked(spark, [(1, f"c{i}", i, "find", f'{{"text":"x","n":{n}}}', []) for i, n in enumerate(given)], [])
    assert [got[1, f"c{i}"].error for i in range(len(given))] == [None] * 3 + ["n is not BIGINT"] * 4
    assert '"n":1,' in got[1, "c1"].message


def test_very_long_texts_in_calls(spark):
    text = 'a "quoted"\n' * 50_000
    got = linked(spark, [(1, "a", 0, "find", json.dumps({"text": text}), [])], [(1, "a", text)])
    assert json.loads(got[1, "a"].message) == {"arguments": {"text": text}, "id": "a", "result": text, "tool": "find"}


def test_no_calls(spark):
    assert linked(spark, [], []) == {}
    chat = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert tool_calls.link(*tool_calls.chat_calls(chat), tool_calls.CHAT_TOOLS).count() == 0
