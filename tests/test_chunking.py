"""Sections and chunks against a plain version written from their description."""

import random
import re
import time

import pytest

from ragloom.operators.chunking import DEFAULT, MAX_CHARS, MIN_CHARS, OVERLAP, recursive_chunks, title_sections


def plain_sections(text):
    found, title, lines, fenced = [], None, [], False
    for line in (x.strip() for x in re.split(r"\r\n?|\n", text or "")):
        if not line:
            continue
        if line.startswith(("```", "~~~")):
            fenced = not fenced
        elif not fenced and re.match(r"#{1,6}\s.+", line):
            if title is not None and len(lines) > 1:
                found.append((title, lines))
            title, lines = line, []
        lines.append(line)
    if title is not None and len(lines) > 1:
        found.append((title, lines))
    return found or ([(None, lines)] if lines else [])


def joined(units, size, overlap):
    """Greedy sums of units, each starting with the last units that fit into the overlap."""
    out, now = [], []
    for unit in units:
        if now and sum(map(len, now)) + len(unit) > size:
            out.append("".join(now))
            while now and (sum(map(len, now)) > overlap or sum(map(len, now)) + len(unit) > size):
                now.pop(0)
        now.append(unit)
    return [*out, "".join(now)] if now else out


def split(text, size, overlap, marks):
    mark = next((m for m in marks if m in text), None)
    if mark is None:
        return [text]
    head, *rest = text.split(mark)
    units = [u for u in [head, *(mark + r for r in rest)] if u]
    out, good = [], []
    for unit in units:
        if len(unit) < size:
            good.append(unit)
            continue
        out += joined(good, size, overlap)
        good = []
        out += split(unit, size, overlap, marks[marks.index(mark) + 1 :])
    return out + joined(good, size, overlap)


def plain_chunks(text, most=MAX_CHARS, least=MIN_CHARS, overlap=OVERLAP):
    chunks = []
    for title, lines in plain_sections(text):
        content, own = "\n".join(lines), title or DEFAULT
        if len(content) <= most:
            chunks.append([None, own, content, ""])
            continue
        body = "\n" + "\n".join(lines[1:]) if title else content
        for piece in split(body, max(most - len(own) - 1, overlap + 1), overlap, ["\n", "。", "！"]):
            if piece.strip():
                chunks.append([own, own, f"{own}\n{piece.strip()}", piece.strip()])
    merged = []
    for parent, own, content, body in chunks:
        last = merged[-1] if merged else None
        if last and last[0] is not None and last[0] == parent and len(last[2]) < least and len(last[2]) + 1 + len(body) <= most:
            last[2] += "\n" + body
        else:
            merged.append([parent, own, content])
    out, before, part = [], None, 0
    for i, (parent, own, content) in enumerate(merged):
        part = part + 1 if parent is not None and parent == before else 1
        before = parent
        out.append((i, f"{own}_{part}", own, part, content))
    return out


def document(rng):
    lines = []
    for _ in range(rng.randint(0, 40)):
        kind = rng.random()
        if kind < 0.12:
            lines.append("#" * rng.randint(1, 7) + rng.choice([" ", "", "\t"]) + rng.choice(["Same", "Head", "标题"]))
        elif kind < 0.2:
            lines.append(rng.choice(["```", "~~~x", " ``` "]))
        elif kind < 0.3:
            lines.append(rng.choice(["", "   ", "　"]))
        else:
            mark = rng.choice(["。", "！", " ", ""])
            lines.append(mark.join("".join(rng.choices("abcd字 ", k=rng.randint(0, 30))) for _ in range(rng.choice([1, 2, 5, 20]))))
    return rng.choice(["\n", "\r\n"]).join(lines)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    return [document(rng) for _ in range(80)] + ["", None, " \n ", "# only", "# a\n# b", "pre\n# A\nbody\n\n```\n# no\n```\n# B\n# C\r\nx", "x" * 5000, "# t\n" + "y" * 3000 + "\n" + "z。" * 900]


def test_sections(spark, texts):
    got = {(r.doc_id, r.section): (r.title, r.content) for r in title_sections(frame(spark, texts)).collect()}
    assert got == {(i, n): (t or DEFAULT, "\n".join(lines)) for i, text in enumerate(texts) for n, (t, lines) in enumerate(plain_sections(text))}


@pytest.mark.parametrize("sizes", [(MAX_CHARS, MIN_CHARS, OVERLAP), (60, 30, 10), (120, 100, 0)])
def test_chunks(spark, texts, sizes):
    most, least, overlap = sizes
    rows = recursive_chunks(frame(spark, texts), max_chars=most, min_chars=least, overlap=overlap).collect()
    got = {(r.doc_id, r.chunk_index): (r.chunk_index, r.title, r.parent_title, r.part, r.content) for r in rows}
    want = {(i, c[0]): c for i, text in enumerate(texts) for c in plain_chunks(text, *sizes)}
    assert len(rows) == len(got) and got == want and any(r.part > 2 for r in rows)


def test_repeated_and_null_ids(spark):
    text = "# A\n" + "line of words\n" * 200
    df = spark.createDataFrame([(1, text), (1, text), (1, "# B\nother"), (None, text), (None, "# B\nother")], "doc_id long, text string").withColumnRenamed("doc_id", "key")
    rows = recursive_chunks(df, "key").collect()
    assert len(rows) == 3 * len(plain_chunks(text)) + 2
    assert sum(r.key is None for r in rows) == len(plain_chunks(text)) + 1


def test_a_megabyte_in_one_document(spark):
    text = "\n".join(f"{'## part ' + str(i) if i % 400 == 0 else 'line'} {i} with some words in it" for i in range(30_000))
    assert len(text) > 900_000
    began = time.time()
    rows = sorted((r.chunk_index, r.title, r.parent_title, r.part, r.content) for r in recursive_chunks(frame(spark, [text])).collect())
    assert rows == plain_chunks(text) and time.time() - began < 120
