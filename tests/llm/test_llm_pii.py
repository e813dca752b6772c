"""Contextual extraction against plain Python: base spans, contexts, rounds and added spans."""

import hashlib
import math
import random
import re
import time
from collections import defaultdict

import regex

from jobloom.llm import pii
from jobloom.llm.pii import CANDIDATE, KINDS, personal_data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SPACE = " \t\n\x0b\f\r"


def passes(kind, found):
    digits = [int(c) for c in found if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def matches(pattern, text, engine):
    found = list(engine.finditer(pattern, text))
    ends = [0] + [m.end() for m in found]
    starts = [m.start() for m in found] + [len(text)]
    for i, m in enumerate(found):
        before, after = text[ends[i] : m.start()][-pii.AROUND :], text[m.end() : starts[i + 1]][: pii.AROUND]
        yield m.start(), m.end(), m.group(), before, after


def base(text):
    out = [(s, KINDS.index(k), e, k, v, b, a) for k, p in BASE.items() for s, e, v, b, a in matches(p, text or "", re) if passes(k, v)]
    return sorted(out)


def contexts(form, before, after):
    before, after = (re.sub("[0-9]", "0", x.lower()) for x in (before, after))
    words, next_ = before.split(), after.split()
    out = []
    if words:
        out.append(f"{form} < {words[-1]}")
    if len(words) > 1:
        out.append(f"{form} << {words[-2]} {words[-1]}")
    if next_:
        out.append(f"{form} > {next_[0]}")
    if words and next_:
        out.append(f"{form} <> {words[-1]} {next_[0]}")
    return out


def form_of(value):
    if re.search(r"@|[(\[]at[)\]]", value):
        return "mail"
    return "address" if re.search(r":|^[0-9]+(\.[0-9]+){3}$", value) else "number"


def name_of(form, value):
    return re.sub("[^0-9]", "", value) if form == "number" else value.lower()


def can_be(kind, form, name):
    if form == "mail" or form == "address":
        return kind == ("email" if form == "mail" else "ip")
    return (kind == "card" and 12 <= len(name) <= 19) or (kind == "phone" and 7 <= len(name) <= 15)


def brute(docs):
    """docs: (id, text) rows."""
    forms = {"email": "mail", "ip": "address", "card": "number", "phone": "number"}
    edges, known, others, bases = set(), defaultdict(dict), [], []
    for at, (_, text) in enumerate(docs):
        bases.append(base(text))
        for *_, kind, value, before, after in bases[-1]:
            form = forms[kind]
            name = name_of(form, value)
            known[form, name][kind] = 1.0
            edges |= {(p, form, name) for p in contexts(form, before, after)}
        for start, end, value, before, after in matches(CANDIDATE, text or "", regex):
            form = form_of(value)
            name = name_of(form, value)
            patterns = contexts(form, before, after)
            edges |= {(p, form, name) for p in patterns}
            others.append((at, start, end, form, name, patterns))
    by_pattern, by_name = defaultdict(set), defaultdict(set)
    for p, form, name in edges:
        by_pattern[p].add((form, name))
        by_name[form, name].add(p)
    scores = dict(known)
    for _ in range(pii.ROUNDS):
        trusted = {}
        for p, names in by_pattern.items():
            for kind in KINDS:
                held = [scores[n][kind] for n in names if kind in scores.get(n, {})]
                share = sum(held) / (len(names) + 1)
                if share >= pii.CONFIDENCE and len(held) >= pii.SUPPORT:
                    trusted[p, kind] = share
        scores = dict(known)
        for (form, name), patterns in by_name.items():
            if (form, name) in known:
                continue
            for kind in KINDS:
                loss = [math.log(1 - trusted[p, kind]) for p in patterns if (p, kind) in trusted]
                if loss and 1 - math.exp(sum(loss)) >= pii.CONFIDENCE and can_be(kind, form, name):
                    scores[form, name] = {**scores.get((form, name), {}), kind: 1 - math.exp(sum(loss))}
    added = defaultdict(list)
    for at, start, end, form, name, patterns in others:
        fits = [(s, -KINDS.index(k), k) for k, s in scores.get((form, name), {}).items() if any((p, k) in trusted for p in patterns)]
        if fits and all(e <= start or s >= end for s, _, e, *_ in bases[at]):
            kind = max(fits)[2]
            added[at].append((start, KINDS.index(kind), end, kind))
    out = []
    for at, (doc, _) in enumerate(docs):
        own = [b[:4] for b in bases[at]]

        def text_of(spans):
            return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))

        counts = [sum(b[3] == k for b in own) for k in KINDS]
        out.append((doc, *counts, hashlib.sha256(text_of(own).encode()).hexdigest(), text_of(own + added[at]), len(added[at])))
    return sorted(out, key=str)


def planted():
    rng = random.Random(3)
    words = "lorem ipsum dolor sit amet the a of to and über 日本".split()

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    def phone(i):
        return f"+1 ({200 + i}) 555-{1000 + i}"

    docs = []
    for i in range(80):
        docs.append(f"{prose(9)} call me at {phone(i)} please {prose(5)}")
        docs.append(f"{prose(4)} write to user{i}@mail{i}.example.com today {prose(3)}")
        docs.append(f"{prose(4)} {10 + i}.20.30.{i} {prose(3)} 44657828894{i:02d} {prose(2)}")
        docs.append(f"order number {700000 + i} shipped {prose(4)} version 2.{i}.10")
    docs += [f"{prose(3)} call me at ({300 + i}) 555-{2000 + i} please {prose(2)}" for i in range(14)]
    # found in the second round: beside identifiers that the first one found
    docs += [f"{prose(3)} reach ({300 + i}) 555-{2000 + i} now and {prose(2)}" for i in range(14)]
    docs += [f"{prose(3)} reach 61255512{i:02d} now and {prose(2)}" for i in range(1)]
    docs += [f"{prose(2)} write to info@intranet today", f"{prose(2)} write to hans [at] firma.de today", "call me at 12 please", "call me at version 7 please"]
    docs += [docs[0]] * 30 + ["order number 12345678 call me at 5551234567 please", "a@b.c_d@e.f x@y.z%q@r.s", "1.2.3.4.5.6.7.8 300.1.1.1 0255.1.1.1"]
    docs += [None, "", "4465758382889437 4465758382889437", "+1 (555) 010-9999 4111 1111 1111 1111 4111-1111-1111-1111"]
    return list(enumerate(docs)) + [(None, docs[0]), (3, docs[4]), (3, docs[4])]


def test_spans_equal_brute_force(spark):
    docs = planted()
    frame = spark.createDataFrame([(*d, 1, "x", "y") for d in docs], "doc_id long, text string, row int, base string, kind string").repartition(3)
    got = sorted((tuple(r) for r in personal_data(frame).collect()), key=str)
    want = brute(docs)
    assert got == want
    added = {r[0]: r[6] for r in want if r[7]}
    assert len(added) >= 28
    assert any("email" in s for s in added.values()) and any("phone" in s for s in added.values())


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted((tuple(r) for r in personal_data(odd_docs).collect()), key=str) == brute(docs)
    assert personal_data(no_docs).count() == 0


def test_time_follows_the_length_of_a_text(spark):
    big = 300_000
    texts = ["a" * big, "7" * big, "1.2.3.4 " * (big // 8), "+1" + " " * big, "a@b" + ".c" * big, "(" * big, "1 " * big, "x@" * big, "12:" * big, "12 34 " * big]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    start = time.time()
    got = {r.doc_id: r for r in personal_data(frame).collect()}
    assert time.time() - start < 120
    assert got[2].n_ip == big // 8 and got[4].n_email == 1 and got[0].spans == ""
