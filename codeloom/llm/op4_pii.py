"""Surrogates for personal data. DataFrame functions only.

Entities found by patterns get keyed replacements of their own type: digits for digits and letters for letters in the
same format and case, octets for octets, valid check digits for cards, names of the same gender and script for names. An entity's
canonical form decides its surrogate, so mentions that differ in case or in signs between digits stay one person, and
the table of distinct canonical forms is checked: a surrogate that another has, or that is itself some real entity, is
drawn again until all are distinct. Texts without entities pass as they are.

Where real entities fill a format (all ten thousand numbers of a kind occur), none is left that is not real: after PLAIN_DRAWS draws
a form takes the form that keyed steps through the alphabet of each place lead to. Different forms then stay different, and draws end.
Given a folder for the mapping, forms keep the surrogates of earlier batches, and new ones are added to it before texts are replaced.

Texts are taken whole; a null text has no entities and stays null; repeated rows are replaced alike; an empty table gives
no rows; other columns are not read by `surrogates`; of two forms that draw one surrogate the smaller form keeps it. Overlapping mentions: the leftmost, then the pattern listed first.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exists, read, scratch, written

#: Names by script and gender.
GIVEN = {
    ("latin", "f"): ["Anna", "Maria", "Emma", "Laura", "Julia", "Sophie", "Clara", "Elena", "Marta", "Alice", "Hannah", "Nora", "Lucia", "Camille", "Ingrid", "Paula"],
    ("latin", "m"): ["John", "Peter", "Paul", "Lukas", "Martin", "Thomas", "David", "Carlos", "Pierre", "Hans", "Oliver", "Simon", "Jorge", "Henri", "Felix", "Robert"],
    ("cyrillic", "f"): ["Анна", "Мария", "Елена", "Ольга", "Ирина", "Наталья", "Вера", "Дарья"],
    ("cyrillic", "m"): ["Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Николай", "Павел", "Андрей"],
}
FAMILY = {
    "latin": ["Adler", "Brandt", "Castell", "Delmar", "Ekholm", "Ferrand", "Garner", "Holmes", "Ibarra", "Jansen", "Keller", "Lambert", "Moreno", "Norden", "Ortega", "Palmer", "Quinn", "Rivers", "Santos", "Turner", "Ulrich", "Varga", "Weber", "Young"],
    "cyrillic": ["Коваль", "Шевченко", "Бондаренко", "Кравец", "Мельник", "Седых", "Черных", "Белых", "Гончар", "Франко", "Долгих", "Руденко"],
}
TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Doña"], "m": ["Mr", "Herr", "Monsieur", "Señor"]}
_LATIN, _CYRILLIC = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+", r"[А-ЯЁ][а-яё]+"
_titles = "|".join(t for ts in TITLES.values() for t in ts)
_latin = "|".join(GIVEN["latin", "f"] + GIVEN["latin", "m"])
_cyrillic = "|".join(GIVEN["cyrillic", "f"] + GIVEN["cyrillic", "m"])
_EDGE, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
#: Types in the order in which they are tried at a place; each pattern holds no group.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,24}" + _END,
    "phone": rf"{_EDGE}\+[0-9]{{1,3}}[ .-]?\(?[0-9]{{2,4}}\)?[ .-]?[0-9]{{3,4}}[ .-]?[0-9]{{3,4}}{_END}|{_EDGE}\([0-9]{{3}}\) ?[0-9]{{3}}-[0-9]{{4}}{_END}|{_EDGE}[0-9]{{3}}-[0-9]{{3}}-[0-9]{{4}}{_END}",
    "ip": rf"(?<![\p{{L}}\p{{N}}.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){{3}}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\p{{L}}\p{{N}}]|\.[0-9])",
    "card": rf"{_EDGE}[0-9]{{4}}(?:[ -]?[0-9]{{4}}){{3}}{_END}",
    "ssn": rf"{_EDGE}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_END}",
    "person": rf"{_EDGE}(?:{_titles})\.? {_LATIN}(?: {_LATIN})?{_END}|{_EDGE}(?:{_latin}) {_LATIN}{_END}|{_EDGE}(?:{_cyrillic}) {_CYRILLIC}{_END}",
}
ANY = "|".join(PATTERNS.values())
#: At these draws and after, names get one more family name each, so that their number never ends.
LONGER_NAMES = 3
#: Draws that must lead to a form that is no real entity; names go on so, other types then take steps.
PLAIN_DRAWS = 6
#: The session setting that holds the key of the query; without it each run draws one of its own.
KEY_SETTING = "spark.codeloom.surrogates.key"


def kind(entity: Column) -> Column:
    """The type of a found entity."""
    out = F.when(F.contains(entity, F.lit("@")), "email").when(F.regexp_like(entity, F.lit(rf"^(?:{PATTERNS['ip']})$")), "ip")
    out = out.when(F.regexp_like(entity, F.lit(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")), "ssn").when(F.regexp_like(entity, F.lit(r"^[0-9]{4}(?:[ -]?[0-9]{4}){3}$")), "card")
    return out.when(F.regexp_like(entity, F.lit(r"^[+(0-9]")), "phone").otherwise("person")


def _digits(e: Column) -> Column:
    return F.regexp_replace(e, "[^0-9]", "")


def _title(e: Column) -> Column:
    """The title with the sign and space after it, or nothing."""
    return F.regexp_extract(e, rf"^(?:{_titles})\.? ", 0)


def _bare(e: Column) -> Column:
    return F.substring(e, F.length(_title(e)) + 1, F.length(e))


def _gender(e: Column) -> Column:
    first = F.substring_index(_bare(e), " ", 1)
    said = F.regexp_extract(e, r"^(\p{L}+)", 1)
    return F.when(said.isin(TITLES["f"]) & (_title(e) != ""), "f").when(_title(e) != "", "m").when(first.isin(GIVEN["latin", "f"] + GIVEN["cyrillic", "f"]), "f").otherwise("m")


def _script(e: Column) -> Column:
    return F.when(F.regexp_like(e, F.lit(r"\p{IsCyrillic}")), "cyrillic").otherwise("latin")


def canonical(kind: Column, e: Column) -> Column:
    """One form for all mentions of an entity: no case, no signs between digits, no title (but the gender it tells)."""
    return F.when(kind.isin("phone", "card", "ssn"), _digits(e)).when(kind == "person", F.concat(_gender(e), F.lit(":"), F.lower(_bare(e)))).otherwise(F.lower(e))


def _seed(key: str, kind: Column, canon: Column, draw: Column) -> Column:
    """128 hexadecimal digits that the key, the entity and the draw decide."""
    parts = [F.sha2(F.concat_ws("\0", F.lit(key), kind, canon, draw.cast("string"), F.lit(str(i))).cast("binary"), 256) for i in (0, 1)]
    return F.concat(*parts)


def _number(seed: Column, i: Column | int, below: int) -> Column:
    """The i-th number under `below` of a seed: from seven hexadecimal digits; each 24 numbers have digits of their own."""
    i = F.lit(i) if isinstance(i, int) else i
    block = F.floor(i / 24).cast("int")
    digits = F.when(block == 0, seed).otherwise(F.sha2(F.concat(seed, block.cast("string")).cast("binary"), 512))
    return F.conv(F.substring(digits, (i % 24) * 5 + 1, F.lit(7)), 16, 10).cast("long") % below


def _chars(e: Column, f) -> Column:
    """e with each character c at place i (from 0) replaced by f(c, i)."""
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(e)), lambda i: f(F.substring(e, i, F.lit(1)), i - 1)), "")


def _luhn(number: Column) -> Column:
    """Sixteen digits with the last one set so that the card number is valid."""
    body = F.substring(number, 1, 15)
    value = lambda i: F.substring(body, i, F.lit(1)).cast("int")
    twice = lambda i: F.when(i % 2 == 1, value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0)).otherwise(value(i))
    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(15)), twice), F.lit(0), lambda a, x: a + x)
    return F.concat(body, ((10 - total % 10) % 10).cast("string"))


def _pick(names: list[str], n: Column) -> Column:
    return F.get(F.array(*map(F.lit, names)), n.cast("int"))


def _family(script: str, seed: Column, draw: Column) -> Column:
    names = FAMILY[script]
    more = F.transform(F.sequence(F.lit(0), F.greatest(draw - LONGER_NAMES, F.lit(-1)) + 1), lambda i: _pick(names, _number(seed, i + 1, len(names))))
    return F.array_join(more, "-")


def surrogate(kind: Column, canon: Column, sample: Column, draw: Column, key: str) -> Column:
    """The canonical surrogate of a canonical entity. sample: some mention of it, for what the form does not tell."""
    seed = _seed(key, kind, canon, draw)
    keep = F.when(kind == "card", 1).when((kind == "phone") & sample.startswith("+"), F.length(F.regexp_extract(sample, r"^\+([0-9]{1,3})(?:[ .(-]|$)", 1))).otherwise(0)
    numbers = _chars(canon, lambda c, i: F.when(i < keep, c).otherwise(_number(seed, i, 10).cast("string")))
    domain = F.length(F.substring_index(canon, ".", -1)) + 1
    letter = lambda i: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), _number(seed, i, 26).cast("int") + 1, F.lit(1))
    email = _chars(canon, lambda c, i: F.when(i >= F.length(canon) - domain, c).when(F.regexp_like(c, F.lit("[0-9]")), _number(seed, i, 10).cast("string")).when(F.regexp_like(c, F.lit("[a-z]")), letter(i)).otherwise(c))
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (1 + _number(seed, i, 254)).cast("string")), ".")
    person = F.lit(None).cast("string")
    two = F.contains(canon, F.lit(" "))
    for (script, gender), given in GIVEN.items():
        first, last = _pick(given, _number(seed, 0, len(given))), _family(script, seed, draw)
        person = F.coalesce(person, F.when((_script(canon) == script) & canon.startswith(gender + ":"), F.lower(F.concat(F.lit(gender + ":"), F.when(two, F.concat(first, F.lit(" "), last)).otherwise(last)))))
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "person", person).when(kind == "card", _luhn(numbers)).otherwise(numbers)


def stepped(kind: Column, canon: Column, draw: Column, key: str) -> Column:
    """Another form of the same shape, by steps that the key, the type, the length and the draw decide and the form itself does not: each place of
    an alphabet moves on by one step or more, so no form stays and two forms never become one (cards: but for their check digit)."""
    seed = _seed(key, kind, F.length(canon).cast("string"), draw)
    digit = lambda c, i: ((c.cast("int") + 1 + _number(seed, i, 9)) % 10).cast("string")
    abc = "abcdefghijklmnopqrstuvwxyz"
    letter = lambda c, i: F.substring(F.lit(abc), ((F.instr(F.lit(abc), c) + _number(seed, i, 25)) % 26 + 1).cast("int"), F.lit(1))
    domain = F.length(canon) - F.length(F.substring_index(canon, ".", -1)) - 1
    email = _chars(canon, lambda c, i: F.when(i >= domain, c).when(F.regexp_like(c, F.lit("[0-9]")), digit(c, i)).when(F.regexp_like(c, F.lit("[a-z]")), letter(c, i)).otherwise(c))
    numbers = _chars(canon, lambda c, i: F.when((kind == "card") & (i == 0), c).otherwise(digit(c, i)))
    ip = F.array_join(F.transform(F.split(canon, r"\."), lambda o, i: ((o.cast("int") + 1 + _number(seed, i, 255)) % 256).cast("string")), ".")
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", _luhn(numbers)).otherwise(numbers)


def rendered(kind: Column, entity: Column, chosen: Column) -> Column:
    """The canonical surrogate in the format of a mention: its signs, its case, its title."""
    ordinal = lambda i: F.length(_digits(F.substring(entity, F.lit(1), i + 1)))
    numbers = _chars(entity, lambda c, i: F.when(F.regexp_like(c, F.lit("[0-9]")), F.substring(chosen, ordinal(i), F.lit(1))).otherwise(c))
    email = _chars(entity, lambda c, i: F.when(F.regexp_like(c, F.lit("[A-Z]")), F.upper(F.substring(chosen, i + 1, F.lit(1)))).otherwise(F.substring(chosen, i + 1, F.lit(1))))
    names = F.regexp_replace(F.initcap(F.regexp_replace(F.substring(chosen, F.lit(3), F.lit(1 << 20)), "-", " - ")), " - ", "-")
    return F.when(kind == "email", email).when(kind == "ip", chosen).when(kind == "person", F.concat(_title(entity), names)).otherwise(numbers)


def distinct_surrogates(forms: DataFrame, key: str, known: DataFrame | None = None) -> DataFrame:
    """(kind, canon, chosen) for distinct (kind, canon, sample): draws again until each is taken by one and, in PLAIN_DRAWS draws, is
    no real entity. known: (kind, canon, chosen) of earlier batches, which stand."""
    spark = forms.sparkSession
    done = written(known.select("kind", "canon", "chosen"), "known") if known is not None else None
    pending = forms if done is None else written(forms.join(done.select("kind", "canon"), ["kind", "canon"], "left_anti"), "pending")
    real = forms.select("kind", F.col("canon").alias("chosen"))
    draw = 0
    while not pending.isEmpty():
        spread = pending.repartition(spark.sparkContext.defaultParallelism, "kind", "canon")  # few bytes, but much to compute
        kind, canon, number = F.col("kind"), F.col("canon"), F.lit(draw)
        chosen = surrogate(kind, canon, F.col("sample"), number, key)
        if draw >= PLAIN_DRAWS:
            chosen = F.when(kind == "person", chosen).otherwise(stepped(kind, canon, number, key))
        drawn = written(spread.withColumn("chosen", chosen), "drawn")
        free = drawn.where("chosen <> canon")
        free = free.join(real if draw < PLAIN_DRAWS else real.where("kind = 'person'"), ["kind", "chosen"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "chosen"), ["kind", "chosen"], "left_anti")
        first = free.groupBy("kind", "chosen").agg(F.min(F.struct("canon", "sample")).alias("who"))
        won = written(first.select("kind", "who.canon", "chosen"), "won")
        done = won if done is None else written(done.union(won), "done")
        pending = written(drawn.select("kind", "canon", "sample").join(won.select("kind", "canon"), ["kind", "canon"], "left_anti"), "pending")
        draw += 1
    return done if done is not None else forms.select("kind", "canon", F.col("canon").alias("chosen"))


def replaced(docs: DataFrame, key: str, mapping: str | None = None) -> DataFrame:
    """docs (all columns, in the struct row) with n_entities and the new text. mapping: a folder that holds (kind, canon, chosen) of all batches;
    it is as secret as the key. A batch that runs again finds its own forms there and gives the same texts."""
    spark = docs.sparkSession
    with scratch(spark):
        found = F.coalesce(F.regexp_extract_all("text", F.lit(ANY), F.lit(0)), F.array())
        # the one written table that holds texts and outlives the scope: finding entities is most of the work, and the result reads it
        marked = written(docs.select(F.struct(*docs.columns).alias("row"), found.alias("found"), F.monotonically_increasing_id().alias("tag")), "marked", keep=True)
        hits = marked.where(F.size("found") > 0)
        mentions = hits.select("tag", F.posexplode("found").alias("place", "entity"))
        entities = written(mentions.select("entity").distinct().withColumn("kind", kind(F.col("entity"))).withColumn("canon", canonical(F.col("kind"), F.col("entity"))), "entities")
        forms = written(entities.groupBy("kind", "canon").agg(F.min("entity").alias("sample")), "forms")
        known = spark.read.parquet(mapping) if mapping and exists(spark, mapping) else None
        chosen = distinct_surrogates(forms, key, known)
        if mapping:
            new = chosen if known is None else chosen.join(known.select("kind", "canon"), ["kind", "canon"], "left_anti")
            written(new, "new").write.mode("append").parquet(mapping)
        table = written(entities.join(chosen, ["kind", "canon"]).select("entity", rendered(F.col("kind"), F.col("entity"), F.col("chosen")).alias("new")), "table")
        lists = mentions.join(table, "entity").groupBy("tag").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "new"))), lambda x: x["new"]).alias("news"))
        lists = written(lists, "lists", keep=True)
    changed = hits.select("row", "tag", "found").join(lists, "tag")
    parts = F.split(F.col("row.text"), ANY, -1)
    text = F.array_join(F.zip_with(parts, F.concat("news", F.array(F.lit(""))), lambda p, s: F.concat(p, s)), "")
    same = marked.where(F.size("found") == 0).select("row", F.lit(0).cast("long").alias("n_entities"), F.col("row.text").alias("new_text"))
    return changed.select("row", F.size("found").cast("long").alias("n_entities"), text.alias("new_text")).union(same)


def surrogates(docs: DataFrame, key: str, mapping: str | None = None) -> DataFrame:
    """One row a document: doc_id, n_entities, text with every entity replaced. key: the secret that decides the surrogates; who has it can test
    guesses of an entity. mapping: see `replaced`."""
    return replaced(docs.select("doc_id", "text"), key, mapping).select("row.doc_id", "n_entities", F.col("new_text").alias("text"))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32)
    return surrogates(read(spark, sf_dir, "documents"), key)
