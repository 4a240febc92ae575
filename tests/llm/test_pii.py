import re

import pytest
from conftest import SF_MID, SF_SMALL

from freshstream.llm import pii
from freshstream.llm.common import table

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def passed(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
        return 16 <= len(d) <= 19 and total % 10 == 0
    return kind != "phone" or 8 <= len(d) <= 15


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS for m in re.finditer(p, text or "") if passed(k, m.group())]


TEXTS = [None, "", "no data", "a@b.c_d@e.f", "x@y", "é日👍 mail me at joe.x+1@mail-2.example.co.uk, 👍 bye",
         "1.2.3.4.5.6.7.8 and 256.1.1.1 and 000255.0.0.1", "4111 1111 1111 1111 or 4111-1111-1111-1112", "4111111111111111",
         "+1 (419) 555-5573 +44 20 7946 0958. +1--2 +123", "a@b.c@d.e", "." * 500 + "a@b.c", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
         "5" * 3000, "9.9.9." * 200, "a" * 20000 + "@", "x@" * 3000, "+" + "1 (" * 2000 + "1", "@@..--", "k" * 3000 + "@a.b" + ".c" * 3000,
         "4111111111111111@1.2.3.4 +4111111111111111"]


def test_base_spans_are_the_patterns(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "a@b.cd", "x"), (3, "a@b.cd", None)],
                                 "doc_id long, text string, spans string").repartition(3)
    got = pii.find(docs).collect()
    assert len(got) == len(TEXTS) + 2
    want = sorted([(i, ",".join(brute(t))) for i, t in enumerate(TEXTS)] + [(-1, "email:0:6"), (3, "email:0:6")])
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.base) for r in got) == want
    for r in got:
        assert set(filter(None, r.base.split(","))) <= set(r.spans.split(","))
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x.startswith(k) for x in r.base.split(",")) for k in pii.KINDS]
    assert pii.find(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_documents(spark, sf):
    docs = table(spark, sf, "documents")
    text = {r.doc_id: r.text for r in docs.collect()}
    got = pii.find(docs).collect()
    assert len(got) == len(text)
    for r in got:
        assert r.base == ",".join(brute(text[r.doc_id]))
    added = [x for r in got for x in set(r.spans.split(",")) - set(r.base.split(",")) if x]
    assert len(added) <= 0.05 * sum(len(r.base.split(",")) for r in got if r.base)


def test_trees_add_looser_spans_but_not_failures(spark):
    rows, at = [], 0
    for i in range(400):
        card = f"4{i:014d}"
        last = next(c for c in "0123456789" if passed("card", card + c))
        bad = str((int(last) + 1) % 10)
        rows.append((at, f"word {i} pay {card}{last} by card, call +1 (2{i % 90 + 10}) 555-{i + 1000} or mail u{i}@mail.example.com"))
        rows.append((at + 1, f"number {card}{bad} of 300.{i}.1.1 and item {i}"))
        at += 2
    rows += [(9000 + i, f"call (212) 555-{1000 + i} now") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    for i in range(20):
        assert got[9000 + i].base == "" and got[9000 + i].spans == "phone:5:19"
    assert all(got[i].spans == "" for i in range(1, 800, 2))


def test_redact(spark):
    docs = spark.createDataFrame([(1, "é joe@x.org, +1 (419) 555-5573!", "s", 3), (2, None, None, 1), (3, "none 👍", "s", 1)],
                                 "row long, text string, kind string, cands int")
    got = {r.row: r for r in pii.redact(docs).collect()}
    assert got[1].text == "é [EMAIL], [PHONE]!" and got[1].kind == "s" and got[1].cands == 3
    assert got[2].text is None and got[3].text == "none 👍"


def test_ipv6_has_its_own_test_of_form(spark):
    good = ["2001:0db8:85a3:0000:0000:8a2e:0370:7334", "fe80:1:2:3:4:5:6:7", "2001:db8::1", "fe80::1ff:fe23:4567:890a"]
    bad = ["00:1A:2B:3C:4D:5E", "12:30:45", "1:2:3:4:5:6:7", "::", "1.2.3.4"]
    docs = spark.createDataFrame([(i, f"host {a}: up, {a}.") for i, a in enumerate(good + bad)], "row long, text string")
    got = pii.spans_of(pii.proposals(docs, docs.text, ["row"])).where("g = 5 AND good").collect()
    assert sorted((r.row, r.match) for r in got) == [(i, a) for i, a in enumerate(good) for _ in "12"]


def test_looser_spans_are_judged_by_evidence_not_by_form_alone(spark):
    clean = ["we arrived at 10.30 sharp", "look at site.Then go", "they stay at home.We do not", "use face::cafe here",
             "order 212 555 1234 is late"]
    private = [("mail joe.smith [at] mail [dot] org now", "email:5:34"), ("contact ann at site dot com", "email:8:27"),
               ("host 2001:db8:1::8a2e:7334 is up", "ip:5:26"), ("call (212) 555-1234 now", "phone:5:19")]
    docs = spark.createDataFrame(list(enumerate(clean + [t for t, _ in private])), "doc_id long, text string")
    got = [r.spans for r in pii.find(docs).orderBy("doc_id").collect()]
    assert got == [""] * len(clean) + [want for _, want in private]
    texts = [r.text for r in pii.redact(docs).orderBy("doc_id").collect()]
    assert texts[:len(clean)] == clean and all("[" + w.split(":")[0].upper() + "]" in t for t, (_, w) in zip(texts[len(clean):], private))


def test_no_plan_carries_the_examples_or_all_steps(spark, monkeypatch):
    """The driver holds a plan many times over; those of the training took hundreds of megabytes."""
    sizes, plain = {}, pii.written

    def measured(df, name):
        sizes[name] = len(df._jdf.queryExecution().optimizedPlan().toString())
        return plain(df, name)

    monkeypatch.setattr(pii, "written", measured)
    pii.find(table(spark, SF_SMALL, "documents")).count()
    assert "pii-train" in sizes and max(sizes.values()) < 100_000, sizes
