import re

import regex

from codeloom.llm import op4_pii as op

ANY = regex.compile(op.ANY)


def test_every_property(spark):
    texts = {
        1: "Write to Ann.Lee42@mail6.example.com or ann.lee42@MAIL6.example.com, call +1 (017) 555-7713 or +1-017-555-7713.",
        2: "Host 97.51.17.173 and 97.51.17.174; card 9807915762804490, 9807-9157-6280-4490; ssn 123-45-6789.",
        3: "Mrs. Anna Weber met Herr Keller and Anna Weber. Анна Коваль и Иван Франко.",
        4: "Nothing here, version 3.10.2.1.5 or 1234.",
        5: None,
        6: "",
        7: "x" * 60_000 + " 10.0.0.1 " + "y" * 60_000,
    }
    rows = [*texts.items(), (1, texts[1]), (None, "10.0.0.1")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS tag", "'f' AS found", "2 AS new_text")
    got = op.surrogates(df, "a key").collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert len({r.text for r in got if r.doc_id == 1}) == 1
    for i, t in texts.items():
        new = by[i].text
        assert by[i].n_entities == len(ANY.findall(t or ""))
        if not ANY.search(t or ""):
            assert new == t
            continue
        assert ANY.split(new) == ANY.split(t) or i == 3  # what is no entity stays
        old_entities, new_entities = ANY.findall(t), ANY.findall(new)
        assert len(old_entities) == len(new_entities)
        if i != 3:
            for a, b in zip(old_entities, new_entities, strict=True):
                assert a != b
                if "." not in a or "@" in a:
                    assert re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", a)))[:-4] == re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", b)))[:-4]
    one, two = ANY.findall(by[1].text), ANY.findall(by[2].text)
    assert one[0].lower() == one[1].lower() and re.sub("[^0-9]", "", one[2]) == re.sub("[^0-9]", "", one[3]) and one[2].startswith("+1 (")
    assert two[0] != two[1] and two[2] == two[3].replace("-", "")
    digits = [int(c) for c in two[2]]
    assert sum(x if k % 2 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(digits)) % 10 == 0
    mrs, herr, again = re.match(r"(Mrs\. \w+ [\w-]+) met (Herr [\w-]+) and (\w+ [\w-]+)\.", by[3].text).groups()
    assert mrs == "Mrs. " + again and again.split()[0] in op.GIVEN["latin", "f"] and "Weber" != again.split()[1] or again != "Anna Weber"
    a, b = re.search(r"\. (\w+ [\w-]+) и (\w+ [\w-]+)\.", by[3].text).groups()
    assert a.split()[0] in op.GIVEN["cyrillic", "f"] and b.split()[0] in op.GIVEN["cyrillic", "m"]
    assert by[None].text == by[7].text.split()[1]
    assert op.surrogates(df.where("false"), "a key").count() == 0
    other = op.surrogates(df, "another key").where("doc_id = 2").first().text
    assert other != by[2].text


def test_names_stay_distinct_beyond_the_lists(spark):
    names = [f"{g} {a}{b}" for g in op.GIVEN["latin", "f"] for a in ("Bal", "Cor", "Dim", "Fer", "Gol", "Hem") for b in "abcdefgh"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "doc_id bigint, text string")
    got = [r.text for r in op.surrogates(df, "a key").collect()]
    assert len(set(got)) == len(names) and not set(got) & set(names)


def test_full_formats_end_and_stay_distinct(spark):
    """All addresses of a short form, all but a few of another, and cards of one issuer: no draw is free, yet all end distinct and changed."""
    texts = [f"{a}{b}@d.de" for a in "0123456789" for b in "0123456789"] + [f"{a}@x{b}.de" for a in "abcdefghijklmnopqrstuvwxy" for b in "0123456789"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in op.surrogates(df, "k").collect()}
    assert len(set(got.values())) == len(texts) and all(got[i] != t for i, t in enumerate(texts))
    assert all(re.sub("[a-z]", "a", re.sub("[0-9]", "9", got[i])) == re.sub("[a-z]", "a", re.sub("[0-9]", "9", t)) for i, t in enumerate(texts))


def test_long_entities_have_no_period(spark):
    local = "a" * 120
    text = spark.createDataFrame([(1, f"{local}@mail.example.org")], "doc_id bigint, text string")
    new = op.surrogates(text, "k").first().text.split("@")[0]
    assert len(new) == 120 and new[:24] != new[24:48] and new[24:48] != new[48:72]


def test_mapping_outlives_batches(spark, tmp_path):
    path = str(tmp_path / "mapping")
    one = spark.createDataFrame([(1, "a1@b.org met 10.0.0.1"), (2, "Mrs. Anna Weber")], "doc_id bigint, text string")
    two = spark.createDataFrame([(3, "A1@b.org and c2@b.org"), (4, "10.0.0.1 10.0.0.2")], "doc_id bigint, text string")
    first = {r.doc_id: r.text for r in op.surrogates(one, "k", path).collect()}
    again = {r.doc_id: r.text for r in op.surrogates(one, "another key", path).collect()}
    assert first == again
    second = {r.doc_id: r.text for r in op.surrogates(two, "another key", path).collect()}
    assert second[3].split()[0].lower() == first[1].split()[0].lower() and second[4].split()[0] == first[1].split()[2]
    rows = spark.read.parquet(path).collect()
    assert len(rows) == len({(r.kind, r.canon) for r in rows}) == len({(r.kind, r.chosen) for r in rows}) == 5


def test_equals_brute_force(spark):
    """Entities by the patterns in another engine, one surrogate a canonical form, rendered by plain Python in each mention's format."""
    rng = __import__("random").Random(3)
    parts = ["ann.lee@x.org", "ANN.LEE@x.org", "+49 030 123-4567", "+490301234567", "(555) 123-4567", "10.1.2.3", "1234 5678 9012 3456", "1234567890123456", "123-45-6789", "plain", "words,", "Герр", "é", "\n", "x@y"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(60)]
    got = {r.doc_id: r.text for r in op.surrogates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "k").collect()}

    def form(e):
        return e.lower() if "@" in e or e.count(".") == 3 else re.sub("[^0-9]", "", e)

    def render(e, chosen):
        if "@" in e:
            return "".join(c.upper() if o.isupper() else c for o, c in zip(e, chosen, strict=True))
        if e.count(".") == 3:
            return chosen
        left = iter(chosen)
        return "".join(next(left) if c.isdigit() else c for c in e)

    table = {}
    for i, t in enumerate(texts):
        for a, b in zip(ANY.findall(t), ANY.findall(got[i]), strict=True):
            assert table.setdefault(form(a), form(b)) == form(b)
    assert len(set(table.values())) == len(table) and not set(table) & set(table.values())
    for i, t in enumerate(texts):
        assert got[i] == ANY.sub(lambda m: render(m[0], table[form(m[0])]), t)


def test_real_table(spark):
    d = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in op.op4_pii_surrogates(spark, d).collect()}
    seen = {}
    for r in spark.read.parquet(d + "/documents.parquet").collect():
        new = rows[r.doc_id].text
        assert rows[r.doc_id].n_entities == len(ANY.findall(r.text))
        assert ANY.split(new) == ANY.split(r.text)
        for a, b in zip(ANY.findall(r.text), ANY.findall(new), strict=True):
            assert seen.setdefault(a, b) == b and a != b
    assert len(set(seen.values())) == len(seen)
