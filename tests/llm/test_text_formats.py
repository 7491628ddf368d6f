"""HTML, chat, byte pairs, mixtures, licences: exact results and round trips."""

from __future__ import annotations

import hashlib
import random
import textwrap
import time
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barlume.llm import bpe, chat, html_extract, licenses, mixing
from barlume.llm.html_blocks import _HIDDEN, blocks
from barlume.llm.html_pages import labelled
from tests.llm.conftest import rows
from tests.llm.pages_by_hand import PAGES

# HTML


def test_blocks():
    page = "<p>a &amp; b<br>c\n d<p><b>e<i>f</b></i></p><script>'</p>'</script><!-- x --><ul><li>g<li>h</ul><h1>i&nbsp;j</h1>k < 3 <a href='>'>l</a>"
    assert [(b.text, b.tag) for b in blocks(page)] == [("a & b c d", "p"), ("ef", "p"), ("g", "li"), ("h", "li"), ("i j", "h1"), ("k < 3 l", "")]
    assert blocks("") == blocks(None) == [] and blocks("<p") != [] and blocks("<style>x") == []


def test_blocks_after_unclosed_elements():
    read = lambda page: [b.text for b in blocks(page)]
    for tag in "button select video audio svg object canvas noscript math template".split():
        for page in (f"<article><p>a</p><{tag}><p>b</p></article><p>c</p>", f"<div><{tag}></div><article><p>a</p><p>b</p></article><{tag}></{tag}><p>c</p>"):
            assert read(page) == ["a", "b", "c"], (tag, page)
    for tag in "script style title textarea iframe".split():
        assert read(f"<p>a</p><{tag}><p>b</p>") == ["a"]
    assert read("<p>a <button>B <i>c</i></button> d <select><option>e<option>f</select> g</p><button>h<p>i</p></button>") == ["a d g"]
    assert read("<p>a <select><option>b<option>c</p><p>d <button>e</p><p>f</p>") == ["a", "d", "e", "f"]
    assert read("<p>a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b</p><object data=u><p>c</p></object>") == ["a x=2 b", "c"]
    assert read("<p>a <svg><path d=''/><path d=''/><title>t</title></svg> b") == ["a b"]
    shown, stand_in = blocks("<p>a</p><video><p>b</p></video>")
    assert shown.mask & _HIDDEN == 0 != stand_in.mask & _HIDDEN


def test_blocks_of_odd_tags():
    read = lambda page: [b.text for b in blocks(page)]
    for opening in ("<script src=/js/>", '<script src="a.js"/>', "<style media=all/>", "<script/>", "<xmp>", "<title/>"):
        tag = opening[1:].split(">")[0].split(" ")[0].split("/")[0]
        assert read(f"<p>a</p>{opening}var x = 1;</{tag} ><p>b</p>") == ["a", "b"], opening
    assert read("<head><title>t</title><script>var s='</head>';</script><meta charset=utf-8><body><p>a") == ["a"]
    assert read("<p>a<!-->b<!--->c<!-- x --!>d<!-- y -->e<!-- z --!f -->g</p><p>h") == ["abcdeg", "h"]
    assert read("<p>a<![CDATA[b]]>c</p><?php x ?><p>d</ >e</p>") == ["ac", "de"]
    assert read("<p>a</p><script><!-- <script> </script> var secret=1; --></script><p>b</p><script><!--><p></script><p>c") == ["a", "b", "c"]
    assert read("<p>a</p><textarea><b></textarea x=1><p>b</p><title>t</title") == ["a", "b"]
    for attribute in ("title='The hidden valley'", 'onclick="this.hidden"', "data-class='sidebar ad'", "title=hidden", "data-hidden", "title='class=ad'", "x='a>b' alt='id=footer'", "=hidden"):
        (block,) = blocks(f"<article {attribute}><p>a</p></article>")
        assert block.mask & (_HIDDEN | html_extract._OFF) == 0, attribute
    for attribute in ("hidden", "HIDDEN=''", "class=ad", "title=x class='big ad'", "/id=footer", "aria-hidden=true", "style='color:red; display : none'", "class=ad class=content"):
        (block,) = blocks(f"<div {attribute}><p>a</p></div>")
        assert block.mask & (_HIDDEN | html_extract._OFF), attribute
    deep = "<div>" * 600 + "<article><h1>b</h1><p>c</p></article><footer>d <button>e</button></footer>" + "</div>" * 600
    b, c, d = blocks(deep)
    assert (b.tag, c.tag, d.text) == ("h1", "p", "d") and b.mask & html_extract._IN and not d.mask & html_extract._IN and d.mask & html_extract._OFF
    assert read("<head><p>a</p><head><p>b</p>") == ["a", "b"] and len(read("<head>" * 4000 + "a")) == 1
    assert [b.text for b in blocks("<x-y><b>" * 4000 + "a" + "</i></x-y></b>" * 4000 + "<p>b")] == ["a", "b"]
    shown = lambda page: [b.text for b in blocks(page) if not b.mask & _HIDDEN]
    assert shown("<p>a <svg><style/><g><title/><text>t</text></g><svg><text>u</text></svg><text>v</text></svg> b</p>") == ["a b"]
    assert read("<object><p>a</p><object><p>b</p></object><p>c</p></object><p>d</p>") == ["a", "b", "c", "d"]
    (block,) = blocks("<p>x <a href=/y/>long link</a></p>")
    assert block.linked == len("long link")
    (block,) = blocks("<p>x <a name='y'/>text</p>")
    assert block.linked == 0


@pytest.mark.parametrize("part", ["<a b=\"c ", "<a ", "<a b='>' ", "<p><b><i>", "</b>", "<div><p>", "<!--", "</title ", "<svg><g>", "<select><button>", "<a b=\"x>", "<script ", "<b><hr>", "<", "<a b>c<x d='", "<tr><td><p><font>"])
def test_hostile_pages_take_time_in_proportion(part):
    began = time.process_time()
    blocks(part * (1_000_000 // len(part)))
    assert time.process_time() - began < 12  # a second or two where nothing else runs


def test_extraction_after_unclosed_elements():
    for tag in ("button", "video", "object"):
        page = f"<html><body><nav><ul><li><a href='/'>Menu</a></li></ul></nav><article><h1>Title here</h1><{tag}><p>One two three four five six.</p><p>Seven eight nine ten eleven.</p></article><footer>&copy; me</footer>"
        assert html_extract.main_texts(html_extract.trained(), [page]) == ["Title here\nOne two three four five six.\nSeven eight nine ten eleven."]


def test_extraction(spark):
    article = "<article><h1>Title here</h1><p>One &lt;two&gt;.<p>Three, four.</article>"
    page = f"<html><head><title>no</title></head><body><nav><ul><li><a href='/'>Menu</a></li></ul></nav><div class=ad>Buy now.</div>{article}<section id=comments><p>Nice.</p></section><footer>&copy; me</footer>"
    table = [(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (None, "u", page, "x"), (1, "u", page, "x"), (4, "u", article + "x" * 100_000, "x")]
    df = spark.createDataFrame(table, "page_id long, url string, html string, text string")
    found = html_extract.extract(df).collect()
    assert len(found) == 6
    for r in found:
        assert r["n_chars"] == len(r["text"])
        if r["page_id"] in (1, None):
            assert r["text"] == "Title here\nOne <two>.\nThree, four."
        if r["page_id"] in (2, 3):
            assert r["text"] == ""
    assert html_extract.extract(df.limit(0)).count() == 0


def test_held_out_pages():
    pages = labelled(120, seed=12345)
    rows_, marks = html_extract.features([p for p, _ in pages]), np.array([m for _, ms in pages for m in ms])
    from barlume.llm import crf

    found = crf.viterbi(html_extract.trained(), rows_, np.array([len(p) for p, _ in pages]))
    assert (found == marks).mean() > 0.98


def test_pages_written_by_hand():
    """Block F1 over layouts that the generator doesn't make."""
    found = html_extract.main_texts(html_extract.trained(), [page for page, _ in PAGES])
    got, want = [Counter(filter(None, text.split("\n"))) for text in found], [Counter(blocks_) for _, blocks_ in PAGES]
    right = sum(sum((g & w).values()) for g, w in zip(got, want, strict=True))
    assert 2 * right / sum(sum(c.values()) for c in got + want) > 0.97


# Chat

pieces = st.sampled_from([*"ab\\[]/<>sINSTROLEU \n", "[INST]", "[/INST]", "<s>", "</s>", "[TURN]", "[/ROLE]", "[", "<"])
texts = st.lists(pieces, max_size=12).map("".join)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool\n[TURN]", ""]), texts), max_size=6))
@settings(max_examples=300, deadline=None)
def test_chat_round_trip(turns):
    template = chat.Template()
    text, spans = template.render([{"role": r, "text": t} for r, t in turns])
    assert [(r, t) for r, t, _ in chat.read_turns(text, template.guard)] == turns
    reader = chat._Reader(template.guard)
    for part, marked in template.parts(({"role": r, "text": t} for r, t in turns), 5):
        reader.add(part, [{"start": a, "stop": b} for a, b in marked])
    loss = "".join(t for r, t in turns if r == "assistant")
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert reader.row() == (len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss), len(text))
    assert [template.guard.undo(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_chat_table(spark):
    said = "</s>[INST] ok [/INST]"
    table = [(1, 1, "assistant", "zwei", "x"), (1, 0, "user", "eins", "x"), (2, 0, None, None, "x"), (-7, 0, "user", said, "x"), (-7, 1, "assistant", said, "x"), (None, 0, "user", "y", "x"), (3, 0, "user", "r", "x"), (3, 0, "user", "r", "x"), (4, None, "user", "L" * 200_000, "x"), (4, 1, "assistant", "", "x")]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string, formatted string")
    found = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert found[1]["turns_sha256"] == sha("user\neins\nassistant\nzwei\n") and found[1]["loss_sha256"] == sha("zwei") and found[1]["loss_chars"] == 4
    assert found[-7]["turns_sha256"] == sha(f"user\n{said}\nassistant\n{said}\n") and found[-7]["loss_sha256"] == sha(said)
    assert found[2]["turns_sha256"] == sha("\n\n") and found[2]["n_turns"] == 1
    assert found[3]["n_turns"] == 2 and found[4]["n_turns"] == 2 and None in found and len(found) == 6
    c = duckdb.connect()
    c.execute("CREATE TABLE t (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    odd = [(8, k, role, x) for k, (role, x) in enumerate((r, x) for r in ("user", "assistant", "tool[TURN]") for x in ("\\[INST]", "a[/RO", "<", "[INST][INST]</s", "\\\\<s>"))]
    c.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [r[:4] for r in table] + odd)
    both = df.drop("formatted").unionByName(spark.createDataFrame(odd, "conv_id long, turn long, role string, text string"))
    got = {tuple(r) for r in chat.read_back(chat.format_conversations(both)).collect()}
    assert got == set(c.sql(chat.read_back_sql("SELECT * FROM t")).fetchall())
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0
    long = spark.createDataFrame([(5, k, "user" if k % 2 else "assistant", f"[INST] {k}") for k in range(3000)], "conv_id long, turn long, role string, text string")
    cut = chat.format_conversations(long, part_chars=1000)
    assert cut.count() > 20
    assert chat.read_back(cut).collect() == chat.read_back(chat.format_conversations(long)).collect()


def test_template_language():
    t = chat.Template("{% for m in messages %}{% if loop.first %}<{% endif %}{{ m['role'] | upper }}:{{ m.text | trim if m.text else 'none' }}{% if not loop.last %};{% else %}>{% endif %}{% endfor %}")
    assert t.render([{"role": "a", "text": " x "}, {"role": "b", "text": ""}])[0] == "<A:x;B:none>"
    assert not t.streams or t.render([])[0] == ""
    assert chat.Template().streams and not chat.Template("{% for a in messages %}{% for b in messages %}{{ b.text }}{% endfor %}{% endfor %}").streams
    assert chat.Template("{% for a in messages %}{% for b in messages %}{{ b.text }}{% endfor %}{% endfor %}").render([{"text": "x"}, {"text": "y"}])[0] == "xyxy"
    folded = chat.Template("a{{ 'b' + 'c' }}{% if 1 == 1 %}d{% else %}{{ x }}{% endif %}").tree
    assert folded == (chat.Show(chat.Const("abcd")),)
    for bad in ("{{ x() }}", "{% set x = 1 %}", "{% if x %}", "{{ x | eval }}", "{{ 'a' < 1 }}", "{% for x y %}{% endfor %}", "{{ " + "(" * 60 + "1" + ")" * 60 + " }}"):
        with pytest.raises(chat.TemplateError):
            chat.Template(bad)
    assert chat.Template("{{ messages.__class__ }}{{ nothing.x }}").render([])[0] == ""
    for deep in ("not " * 3000 + "a", "a" + ".b" * 3000, "a" + " + b" * 3000, "a" + "[0]" * 3000, "a" + " | trim" * 3000, "a" + " if a else b" * 3000):
        with pytest.raises(chat.TemplateError):
            chat.Template("{{ " + deep + " }}")
    for bad in ("{{ 'x }}", "{{ x", "{% if x", "a {{ b"):
        with pytest.raises(chat.TemplateError):
            chat.Template(bad)
    assert chat.Template("{{ '}}' }}{% if '%}' == \"%}\" %}{{ \"{{ '\\\"}}\" }}{% endif %}").render([])[0] == "}}{{ '\"}}"
    assert chat.Template("{{ a" + " ~ 'x'" * 140 + " }}").render([])[0] == "x" * 140


# Byte pairs


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


odd_text = st.text(alphabet=st.characters(codec="utf-8") | st.sampled_from(list("abcdethiz '<|>\tİΣẛ̣​ ")), max_size=60)


@given(st.lists(odd_text, min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_bpe_is_the_library(tokenizer, encoder, found):
    flat, bounds = encoder.encode(found)
    for i, text in enumerate(found):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        ids = flat[bounds[i] : bounds[i + 1]].tolist()
        assert ids == want
        assert encoder.decode(ids) == tokenizer.decode(want, skip_special_tokens=False)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.load())


def test_bpe_table(spark, docs, none, tokenizer):
    texts = {r[0]: r[1] or "" for r in rows()}
    texts[300] = "<|endoftext|>aaaaaaa <|startoftext|>don't I'LL"
    extra = spark.createDataFrame([(300, texts[300])], "doc_id long, text string")
    found = bpe.encode_decode(docs.select("doc_id", "text").unionByName(extra)).collect()
    assert len(found) == docs.count() + 1
    for r in found:
        assert r["ids"] == tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["decoded"] == tokenizer.decode(r["ids"], skip_special_tokens=False)
    assert bpe.encode_decode(docs).count() == docs.count() and bpe.encode_decode(none).count() == 0


# Mixtures


def test_poisson_inverse(spark):
    from pyspark.sql import functions as F

    rng = random.Random(1)
    cases = [(rng.random(), m) for m in (0.0, 0.01, 0.7, 3.0, 40.0, 900.0) for _ in range(60)] + [(0.0, 2.0), (1 - 2**-52, 2.0)]

    def inverse(u, mean):
        if mean == 0:
            return 0
        log, cdf, k = -mean, np.exp(-mean), 0
        while cdf <= u and k < mean + 12 * mean**0.5 + 40:
            k += 1
            log += np.log(mean / k)
            cdf += np.exp(log)
        return k

    df = spark.createDataFrame(cases, "u double, mean double")
    assert [r["k"] for r in df.select(mixing.poisson_inverse(F.col("u"), F.col("mean")).alias("k")).collect()] == [inverse(u, m) for u, m in cases]


@pytest.mark.parametrize("most", [10_000, 1])
def test_mixture(spark, docs, none, monkeypatch, most):
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", most)
    found = mixing.mix(docs, temperature=0.5, size=3.0)
    got = sorted((str(r["doc_id"]), r["copies"], r["replica"], r["shuffle_key"]) for r in found.collect())
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [r[:5] for r in rows()])
    want = c.sql(mixing.mix_sql(size=3.0)).fetchall()
    assert got == sorted((str(r[0]), r[5], r[6], r[7]) for r in want)
    assert set(docs.columns) - {"copies"} <= set(found.columns)
    assert mixing.mix(none).count() == 0
    only = mixing.mix(docs, {"s0": 3.0, None: 1.0}, size=20.0)
    assert {r["source"] for r in only.select("source").distinct().collect()} == {"s0", None}


def test_mixture_meets_its_weights(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "CASE WHEN id % 10 = 0 THEN 'rare' ELSE 'common' END AS source", "'x' AS text")
    found = {r["source"]: r["count"] for r in mixing.mix(df, {"rare": 1.0, "common": 1.0}).groupBy("source").count().collect()}
    assert all(abs(n - 10_000) < 400 for n in found.values())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rows_without_ids_meet_their_weight(spark, seed):
    """50 rows without an id and 50 that share one draw apart, by their texts."""
    df = spark.range(100).selectExpr("CASE WHEN id >= 50 THEN 7 END AS doc_id", "concat('text ', id) AS text", "CASE WHEN id < 50 THEN 'none' ELSE 'same' END AS source")
    found = {r["source"]: r["count"] for r in mixing.mix(df, {"none": 1.0, "same": 1.0}, seed=seed).groupBy("source").count().collect()}
    assert all(abs(found[s] - 50) < 4 * 50**0.5 for s in ("none", "same")), found


# Licences


def test_licenses(spark):
    table = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.txt", "plain words"), (3, "a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        (4, "a/b/c/d/y.txt", "more words"), (5, "z/q.txt", "Licensed under the Apache License, Version 2.0.\nwords"), (6, "z/r.txt", "no words of that kind"), (7, None, "Released under the MIT License."),
        (8, None, None), (9, "a/b/e.txt", ""), (9, "a/b/e.txt", ""), (10, "top.txt", "the license of the version is this"), (11, "ab/x.txt", "w"), (12, "a/b/c/LICENSE", "w " * 50_000),
    ]
    df = spark.createDataFrame([(*r, "x") for r in table], "doc_id long, path string, text string, license string")
    found = {r["doc_id"]: (r["license"], r["origin"]) for r in licenses.scan(df).collect()}
    assert found == {
        1: ("MIT", "own"), 2: ("MIT", "inherited"), 3: ("GPL-3.0", "own"), 4: ("GPL-3.0", "inherited"), 5: ("Apache-2.0", "own"), 6: (None, "none"), 7: ("MIT", "own"),
        8: (None, "none"), 9: ("MIT", "inherited"), 10: (None, "none"), 11: (None, "none"), 12: ("GPL-3.0", "inherited"),
    }
    assert {(r["doc_id"], r["license"], r["origin"], r["similarity"]) for r in licenses.scan(df).collect()} == set(_sql(table))
    assert licenses.scan(df.limit(0)).count() == 0
    plan = licenses.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_licenses_weigh_every_term(spark):
    line = "It was then all at once released to us under the MIT License"
    texts = [line] + [f"it was then all at once to us w{i}" for i in range(199)]
    found = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame([(i, f"d/{i}.txt", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")).collect()}
    bags = [licenses.terms_of(t) for t in texts]
    idf = lambda t: np.log((1 + len(bags)) / (1 + sum(t in b for b in bags))) + 1
    unit, best = bags[0], licenses.terms_of(licenses.TEMPLATES["MIT"])
    cosine = sum(idf(t) ** 2 for t in best) / np.sqrt(sum(idf(t) ** 2 for t in best) * sum(idf(t) ** 2 for t in unit))
    assert found[0]["license"] == "MIT" and abs(found[0]["similarity"] - cosine) < 2e-6
    assert all(found[i]["license"] is None for i in range(1, 200))


def test_licenses_wrapped_over_lines(spark):
    wrapped = {name: "\n".join(textwrap.wrap(licenses.TEMPLATES[name], 24, initial_indent="# ", subsequent_indent="# ")) for name in ("MIT ", "BSD-3-Clause", "GPL-3.0 ")}
    prose = "\n".join(f"{a} walked along the {b} river and saw nothing\n" for a, b in zip("abcdefghij", "klmnopqrst", strict=True))
    table = [(i, f"d/{i}.txt", f"{prose}{w}\n{prose}") for i, w in enumerate(wrapped.values())] + [(i, f"d/{i}.txt", prose) for i in range(3, 30)]
    out = licenses.scan(spark.createDataFrame(table, "doc_id long, path string, text string")).collect()
    assert sorted((r["doc_id"], r["license"], r["origin"], r["similarity"]) for r in out) == _sql(table)
    found = {r["doc_id"]: (r["license"], r["origin"]) for r in out}
    assert found == {i: (name.strip(), "own") for i, name in enumerate(wrapped)} | {i: (None, "none") for i in range(3, 30)}


def _sql(table):
    c = duckdb.connect()
    c.execute("CREATE TABLE t (doc_id BIGINT, path VARCHAR, text VARCHAR)")
    c.executemany("INSERT INTO t VALUES (?, ?, ?)", table)
    return sorted(c.sql(f"SELECT doc_id, license, origin, similarity FROM ({licenses.scan_sql('SELECT * FROM t')})").fetchall())


def test_licence_files(spark):
    holder = "The {} Licence\n\nCopyright (c) 2019 Ada Muster and others\n\n"
    files = [(name, holder.format(name) + "\n".join(textwrap.wrap(text, width))) for name, text in licenses.TEXTS.items() for width in (72, 1000)]
    files += [(name.strip(), f"/*\n{textwrap.fill(text, 60, initial_indent=' * ', subsequent_indent=' * ')}\n */\nint main(int argc) {{ return {i}; }}\n" * 2) for i, (name, text) in enumerate(licenses.TEMPLATES.items())]
    prose = [(None, f"{a} walked along the river with {b} and it was a use of the time\nno conditions were set") for a, b in zip("abcdefghijkl", "mnopqrstuvwx", strict=True)]
    table = [(i, f"p{i}/LICENSE", text) for i, (_, text) in enumerate(files + prose)]
    out = licenses.scan(spark.createDataFrame(table, "doc_id long, path string, text string")).collect()
    assert {r["doc_id"]: r["license"] for r in out} == {i: name for i, (name, _) in enumerate(files + prose)}
    assert sorted((r["doc_id"], r["license"], r["origin"], r["similarity"]) for r in out) == _sql(table)


def test_neighbours_of_a_licence_are_not_it(spark):
    """Other versions and members of a family have their own name or none, not that of a permissive cousin."""
    library = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    mozilla = licenses.TEMPLATES["MPL-1.1"]
    cases = {
        "Licensed under CC BY-ND 4.0": "CC-BY-ND-4.0", mozilla: "MPL-1.1", library: "LGPL-2.0", "This program is distributed under the terms of the Artistic License 2.0.": "Artistic-2.0", "Licensed under the Artistic License, Version 2.0": "Artistic-2.0",
        licenses.TEMPLATES["GFDL-1.3"]: "GFDL-1.3", "Released under the X11 License": "X11", "Licensed under CC BY-NC-SA 4.0": "CC-BY-NC-SA-4.0",
        "Licensed under CC BY 3.0": None, "Licensed under the Apache License, Version 1.1": None, mozilla.replace("1.1", "1.0"): None, "GNU Lesser General Public License, version 2": None, "Released under the Expat License": None,
        "This work is licensed under a Creative Commons Attribution-NoDerivs 4.0 International License": None, "Distributed under the Pump Software License, Version 1.0": None,
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 1.0": None, "This work is licensed under the GNU Affero General Public License, version 2": None,
        "Licensed under CC BY 4.0": "CC-BY-4.0", "Licensed under the Apache License, Version 2.0 (see the file)": "Apache-2.0", "Released under the MIT license.": "MIT", "This work is licensed under the GNU General Public License, version 2": "GPL-2.0",
    }
    prose = [" ".join(["the", "quick", "brown", "dog", "of", "this", "and", "that", "software", "work"][k % 10 : k % 7 + 5]) + f" number{k}" for k in range(60)]
    rows = [(i, f"d{i}/x.txt", f"{prose[i]}\n{text}\n{prose[-i]}") for i, text in enumerate(cases)] + [(100 + i, "p/x.txt", text) for i, text in enumerate(prose)]
    out = licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()
    assert {text: r["license"] for r in out if r["doc_id"] < 100 for text in [list(cases)[r["doc_id"]]]} == cases
    assert all(r["license"] is None for r in out if r["doc_id"] >= 100)
    assert sorted((r["doc_id"], r["license"], r["origin"], r["similarity"]) for r in out) == _sql(rows)
