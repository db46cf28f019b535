"""Replacement of personal data by keyed surrogates; SQL functions only.

Every detected entity is normalised (letter case, separators) and replaced by a
surrogate drawn from a keyed hash of its type and normal form, so equal entities get
equal surrogates everywhere. A surrogate keeps its entity's type and format: digits
stay digits in the same places, card numbers keep their first digit and a right check
digit, addresses stay addresses and those of one domain share one, names keep gender,
script and number of words. A name is detected by its title; where it, or its family
name alone, occurs again in the same text without one, it gets the same surrogate.

Distinct entities are kept distinct by a check over all of them: where two would get
one surrogate, or a surrogate is itself an entity of the corpus, the later one draws
again until none clash. The redrawn ones are few; only they are joined to documents.
Detection runs twice, once for that check and once to replace: entities are never
written beside their documents, the tables of the check are deleted once it is done,
and what stays names entities by keyed digests.

The default key is for tests; give a secret one in production.

Defined cases: a null text stays null and an empty one empty, with no entity; a null
doc_id stays null; repeated rows get equal results; other columns, whatever their
names, are kept by ``surrogated``, except that its own n_found and kinds stand for
columns of these names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import cut, drop_cut, places, renamed

KEY = "pixelmill-test-key"
SHORT = 3  # attempts after which a name, mail address or secret gets letters added, as its shape may have too few values
WIDE = 8  # attempts after which the other kinds get longer with each, so that the redraw always ends
MOST_BROADCAST = 10_000  # documents with a redrawn entity; more are joined by a shuffle

# What is detected, in the order in which a match is named.
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PREFIX = r"(?i:(?:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?)"
HIM = "Mr|Sir|Herr|Monsieur|Señor|Sr|Господин"
HER = "Mrs|Ms|Miss|Madam|Frau|Madame|Mme|Señora|Sra|Госпожа"
TITLE = rf"(?:{HIM}|{HER})(?:\.\s{{0,3}}|\s{{1,3}})"
# Particles of names, and articles that follow them; each is replaced by another of its list.
PARTICLES, ARTICLES = "van von de del di da du dos zu ten ter bin ibn".split(), "der den dem la las los".split()
CAPITAL = r"(?:\p{Ll}{1,2}['’])?\p{Lu}[\p{L}\p{M}]*+(?:['’-][\p{L}\p{M}]++)*+"
PART = rf"(?:\p{{Lu}}\.\s{{0,3}})*+(?!(?:{HIM}|{HER})(?!\p{{L}}))(?:(?:{'|'.join(PARTICLES)})\s{{1,3}}(?:(?:{'|'.join(ARTICLES)})\s{{1,3}})?)?{CAPITAL}"
PATTERNS = {
    "secret": r"(?<![A-Za-z0-9])" + PREFIX + r"[A-Za-z0-9_+/=.-]{8,}+",
    "access_key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+",
    "ipv4": r"(?<![\d.])(?:" + OCTET + r"\.){3}" + OCTET + r"(?!\d|\.\d)",
    "national_id": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w.])(?:(?:[3-6]\d{3}|222[1-9]|22[3-9]\d|2[3-6]\d{2}|27[01]\d|2720)(?:[ -]?\d{4}){2}[ -]?\d{1,7}|[3-6]\d{3}[ -]\d{6}[ -]\d{4,5})(?!\w)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{3})[ .-]\d{3}[ .-]?\d{4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){3,4}(?!\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "name": r"(?<!\p{L})" + TITLE + PART + r"(?:\s{1,3}" + PART + r")*+",
}
# Inside a word of ASCII letters nothing but an address of digits can begin, so most places are left after two looks.
PATTERN = r"(?:(?<![A-Za-z])|(?=[0-9]))(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
LATIN, CYRILLIC, GREEK, ARMENIAN = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω", "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցփքօֆ"
SCRIPTS = {"Cyrillic": CYRILLIC, "Greek": GREEK, "Armenian": ARMENIAN}  # letters of other scripts become Latin ones
GIVEN = {("m", "latin"): "Adam Bruno Carl David Edgar Felix Georg Hugo Ivan Jonas Karl Louis Marc Nils Oscar Paul".split(), ("f", "latin"): "Anna Berta Clara Dora Emma Flora Greta Helena Ida Julia Klara Laura Maria Nora Olga Paula".split(), ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Захар Игорь".split(), ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Зоя Ирина Ольга".split()}


def let(value, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def kind_of(entity: Column) -> Column:
    """The name of the first pattern that fits the whole of a match; of a card, the check digit must be right too."""
    found = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        body = pattern.replace("(?<![A-Za-z0-9._%+-])", "").replace("(?<![A-Za-z0-9])", "")
        fits = entity.rlike(f"^(?:{body})$")
        if name == "card":
            fits = fits & let(F.regexp_replace(entity, "[^0-9]", ""), lambda d: checked(d) == d)
        found = F.when(fits, name).otherwise(found)
    return found


def normal(kind: Column, entity: Column) -> Column:
    """What makes two entities of a kind the same."""
    gender = F.when(entity.rlike(rf"^(?:{HER})(?!\p{{L}})"), "f ").otherwise("m ")
    words = F.regexp_replace(F.regexp_replace(F.regexp_replace(entity, "^" + TITLE, ""), r"\.\s*", ". "), r"\s+", " ")
    return (
        F.when(kind == "secret", F.regexp_replace(entity, "^" + PREFIX, ""))
        .when(kind == "email", F.lower(entity))
        .when(kind.isin("card", "phone", "national_id"), F.regexp_replace(entity, r"[^0-9]", ""))
        .when(kind == "iban", F.regexp_replace(entity, " ", ""))
        .when(kind == "name", F.concat(gender, words))
        .otherwise(entity)
    )


def named(entity: Column) -> Column:
    """A struct of entity, kind and normal form."""
    return let(F.struct(entity.alias("e"), kind_of(entity).alias("kind")), lambda x: F.struct(x["e"].alias("e"), x["kind"].alias("kind"), normal(x["kind"], x["e"]).alias("norm")))


def _number(seed: Column, i) -> Column:
    """A number from the seed and a place."""
    return F.conv(F.substring(F.sha2(F.concat(seed, F.lit(":"), i.cast("string")), 256), 1, 12), 16, 10).cast("long")


def _draw(seed: Column, i: int, among: int) -> Column:
    return (_number(seed, F.lit(i)) % among).cast("int")


def shaped(text: Column, seed: Column) -> Column:
    """A string of the same shape: digits, small and capital letters of a script stay what they are, marks go, the rest stays."""

    def letter(alphabet, n):
        return F.substring(F.lit(alphabet), (n % len(alphabet)).cast("int") + 1, F.lit(1))

    def drawn(x):
        c, n = x["c"], x["n"]
        return (
            F.when(c.rlike("^[0-9]$"), (n % 10).cast("string"))
            .when(c.rlike("^[a-z]$"), letter(LATIN, n))
            .when(c.rlike("^[A-Z]$"), letter(LATIN.upper(), n))
            .when(c.rlike(r"^[\x00-\x7F]$"), c)
            .otherwise(other(c, n))
        )

    def other(c, n):
        found = F.when(c.rlike(r"^\p{M}$"), "").when(~c.rlike(r"^\p{L}$"), c)
        for script, alphabet in {**SCRIPTS, "": LATIN}.items():
            of = c.rlike(rf"^\p{{Is{script}}}$") if script else F.lit(True)
            found = found.when(of & c.rlike(r"^\p{Lu}$"), letter(alphabet.upper(), n)).when(of, letter(alphabet, n))
        return found

    places = F.filter(F.sequence(F.lit(0), F.length(text)), lambda i: i > 0)
    return F.array_join(F.transform(places, lambda i: let(F.struct(F.substring(text, i, F.lit(1)).alias("c"), _number(seed, i).alias("n")), drawn)), "")


def checked(digits: Column) -> Column:
    """A digit string with the last digit set so that the Luhn sum is a multiple of ten."""

    def term(i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when((F.length(digits) - i) % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits) - 1), term), F.lit(0), lambda a, b: a + b)
    return F.concat(F.substring(digits, F.lit(1), F.length(digits) - 1), ((10 - total % 10) % 10).cast("string"))


def family_of(norm: Column) -> Column:
    """The family name of a name's normal form."""
    return F.element_at(F.split(norm, " "), -1)


def surrogate(kind: Column, norm: Column, attempt: Column, key: str, family: Column | None = None) -> Column:
    """The surrogate, in normal form, that an attempt draws for an entity.

    A name's family name is drawn from the family name alone, and each part before it
    from gender and part, so that all mentions of a person agree. ``family`` is the
    family name drawn for a name; the first attempt's if there is none. The kind
    "family" draws such a one.
    """
    first = surrogate(F.lit("family"), family_of(norm), F.lit(0), key, F.lit("")) if family is None else family

    def from_seed(seed):
        octets = F.concat_ws(".", *[(_draw(seed, i, 254) + 1).cast("string") for i in range(4)])
        rest = lambda first: F.substring(shaped(norm, seed), F.lit(first), F.length(norm))
        local = shaped(F.regexp_extract(norm, r"^[^@]*", 0), seed)
        host = let(F.sha2(F.concat_ws("|", F.lit(key), F.lit("host"), F.regexp_extract(norm, r"@(.*)", 1)), 256), lambda x: shaped(F.regexp_extract(norm, r"@([^.]*)", 1), x))
        more = F.when(attempt >= SHORT, shaped(F.lit("abcdefgh"), F.concat(seed, F.lit("more")))).otherwise("")
        wide = F.when(attempt >= WIDE, shaped(F.repeat(F.lit("0"), attempt - WIDE + 1), F.concat(seed, F.lit("wide")))).otherwise("")
        return (
            F.when(kind == "email", F.concat(local, more, F.lit("@"), host, F.lit(".example.org")))
            .when(kind == "ipv4", F.concat(octets, F.when(attempt >= WIDE, F.concat(F.lit(":"), wide)).otherwise("")))
            .when(kind == "access_key", F.concat(F.lit("AKIA"), rest(5), wide))
            .when(kind == "card", let(F.concat(F.when(norm.startswith("2"), F.concat(F.lit("2"), (_draw(seed, 1, 500) + 221).cast("string"), rest(5))).otherwise(F.concat(F.substring(norm, 1, 1), rest(2))), wide), checked))
            .when(kind == "national_id", F.concat(F.when(attempt >= SHORT, rest(1)).otherwise(F.concat(F.lit("9"), rest(2))), wide))
            .when(kind == "phone", F.concat(F.substring(norm, F.lit(1), F.length(norm) - 10), (_draw(seed, 0, 8) + 2).cast("string"), F.substring(shaped(norm, seed), -9, 9), wide))
            .when(kind == "iban", F.concat(F.substring(norm, 1, 2), rest(3), wide))
            .when(kind == "family", F.concat(shaped(norm, seed), F.when(attempt >= SHORT, _letters(norm, seed)).otherwise("")))
            .when(kind == "name", F.concat(F.substring(norm, 1, 2), _name(F.substring(norm, 1, 1), F.split(F.substr(norm, F.lit(3)), " "), first, attempt, key)))
            .otherwise(F.concat(shaped(norm, seed), more))
        )

    return let(F.sha2(F.concat_ws("|", F.lit(key), kind, norm, attempt.cast("string")), 256), from_seed)


def _letters(text: Column, seed: Column) -> Column:
    """Eight letters more, of the script of ``text``."""
    template = F.lit("abcdefgh")
    for script, alphabet in SCRIPTS.items():
        template = F.when(text.rlike(rf"\p{{Is{script}}}"), alphabet[:8]).otherwise(template)
    return shaped(template, F.concat(seed, F.lit("more")))


def _name(gender: Column, parts: Column, family: Column, attempt: Column, key: str) -> Column:
    """A name with the given ``family`` name; what comes before is drawn part by part."""

    def drawn(part):
        seed = F.sha2(F.concat_ws("|", F.lit(key), F.lit("given"), gender, part, attempt.cast("string")), 256)
        return let(seed, lambda x: F.when((attempt >= WIDE) & part.endswith("."), shaped(F.lit("Abcdefgh"), x)).otherwise(F.concat(_before(gender, part, x), F.when((attempt >= SHORT) & ~part.endswith(".") & ~part.isin(*PARTICLES, *ARTICLES), _letters(part, x)).otherwise(""))))

    return F.array_join(F.concat(F.transform(F.slice(parts, 1, F.size(parts) - 1), drawn), F.array(family)), " ")


def _other(part: Column, names: list[str], seed: Column) -> Column:
    """One of ``names`` that isn't ``part``."""
    kept = F.array_remove(F.array(*map(F.lit, names)), part)
    return F.element_at(kept, (_number(seed, F.lit(0)) % F.size(kept)).cast("int") + 1)


def _before(gender: Column, part: Column, seed: Column) -> Column:
    """What stands for a part before the family name: an initial, a particle or a given name."""
    drawn = F.when(part.endswith("."), shaped(part, seed)).when(part.isin(*PARTICLES), _other(part, PARTICLES, seed)).when(part.isin(*ARTICLES), _other(part, ARTICLES, seed))
    for (of, script), names in GIVEN.items():
        drawn = drawn.when((gender == of) & (part.rlike(r"\p{IsCyrillic}") == F.lit(script == "cyrillic")), _other(part, names, seed))
    return drawn


def rendered(kind: Column, entity: Column, drawn: Column) -> Column:
    """A surrogate in the format of the entity that it replaces."""

    def placed(i):
        nth = F.length(F.regexp_replace(F.substring(entity, F.lit(1), i), r"[^0-9A-Z]", ""))
        return let(F.substring(entity, i, F.lit(1)), lambda c: F.when(c.rlike("^[0-9A-Z]$"), F.substring(drawn, nth, F.lit(1))).otherwise(c))

    beyond = F.substr(drawn, F.length(F.regexp_replace(entity, r"[^0-9A-Z]", "")) + 1)
    return (
        F.when(kind.isin("card", "phone", "national_id", "iban"), F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.length(entity)), placed), ""), beyond))
        .when(kind == "secret", F.concat(F.regexp_extract(entity, "^" + PREFIX, 0), drawn))
        .when(kind == "name", F.concat(F.regexp_extract(entity, "^" + TITLE, 0), F.substring(drawn, F.lit(3), F.length(drawn))))
        .when((kind == "email") & (F.upper(entity) == entity), F.upper(drawn))
        .otherwise(drawn)
    )


def _found(text) -> Column:
    """All matches of a text, each with its kind and normal form."""
    return F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), named)


def entities(docs: DataFrame) -> DataFrame:
    """(kind, norm) of all distinct entities."""
    return docs.select(F.explode(_found(F.col("text"))).alias("x")).select("x.kind", "x.norm").where("kind is not null").distinct()


def assigned(found: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, norm, attempt, drawn) with distinct surrogates, none of them an entity itself; written by ``cut``.

    Family names are settled first, then names with them; a name's attempts count both.
    """
    families = found.where("kind = 'name'").select(F.lit("family").alias("kind"), family_of(F.col("norm")).alias("norm")).distinct()
    settled = _settled(families.withColumn("family", F.lit("")), key)
    families = settled.select(F.col("norm").alias("_of"), F.col("drawn").alias("family"), F.col("attempt").alias("_before"))
    of = F.when(F.col("kind") == "name", family_of(F.col("norm")))
    whole = cut(found.select("kind", "norm", of.alias("_of")).join(families, "_of", "left").select("kind", "norm", "family", F.coalesce("_before", F.lit(0)).alias("_before")))
    table = _settled(whole.select("kind", "norm", "family"), key)
    out = cut(table.select("kind", "norm", "attempt", "drawn").join(whole.select("kind", "norm", "_before"), ["kind", "norm"]).select("kind", "norm", (F.col("attempt") + F.col("_before")).alias("attempt"), "drawn"))
    for done in (settled, whole, table):
        drop_cut(done)
    return out


def _settled(found: DataFrame, key: str) -> DataFrame:
    """(kind, norm, family, attempt, drawn) of ``found`` (kind, norm, family), redrawn until all are distinct and none an entity."""
    draw = surrogate(F.col("kind"), F.col("norm"), F.col("attempt"), key, F.col("family"))
    table = cut(found.withColumn("attempt", F.lit(0)).withColumn("drawn", draw))
    while True:
        several = table.groupBy("kind", "drawn").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "norm")).alias("first")).where("n > 1")
        late = table.join(several, ["kind", "drawn"]).where(F.struct("attempt", "norm") != F.col("first")).select("kind", "norm")
        taken = table.select("kind", "norm", "drawn").join(found.select("kind", F.col("norm").alias("drawn")), ["kind", "drawn"], "left_semi").select("kind", "norm")
        again = cut(late.unionByName(taken).distinct().withColumn("again", F.lit(1)))
        if again.isEmpty():
            drop_cut(again)
            return table
        more = table.join(again, ["kind", "norm"], "left")
        kept = more.where("again is null").select("kind", "norm", "family", "attempt", "drawn")
        redrawn = more.where("again = 1").select("kind", "norm", "family", (F.col("attempt") + 1).alias("attempt")).withColumn("drawn", draw)
        new = cut(kept.unionByName(redrawn))
        drop_cut(table)
        drop_cut(again)
        table = new


def _digest(kind, norm, key: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit("entity"), kind, norm), 256)


def _redrawn(docs: DataFrame, key: str) -> DataFrame | None:
    """(_name, _sha, _redrawn): of each document the surrogates that aren't the first attempt's, by the entity's digest."""
    found = cut(entities(docs))
    table = assigned(found, key)
    exceptions = table.where("attempt > 0")
    redrawn = None
    if not exceptions.isEmpty():
        each = docs.select("_name", "_sha", F.explode(_found(F.col("text"))).alias("x")).select("_name", "_sha", "x.kind", "x.norm").where("kind is not null").distinct()
        redrawn = cut(each.join(exceptions, ["kind", "norm"]).groupBy("_name", "_sha").agg(F.map_from_entries(F.collect_set(F.struct(_digest(F.col("kind"), F.col("norm"), key), "drawn"))).alias("_redrawn")))
    drop_cut(found)
    drop_cut(table)
    return redrawn


def _mentions(found: Column, drawn: Column) -> Column:
    """(old, new) of each name of a text without its title, and of its family name, the longest first."""

    def pairs(z):
        whole = F.struct(F.regexp_replace(z["x"]["e"], "^" + TITLE, "").alias("old"), F.substr(z["d"], F.lit(3)).alias("new"))
        family = F.struct(family_of(z["x"]["norm"]).alias("old"), F.element_at(F.split(z["d"], " "), -1).alias("new"))
        return F.array(whole, family)

    names = F.filter(F.arrays_zip(found.alias("x"), drawn.alias("d")), lambda z: F.coalesce(z["x"]["kind"] == "name", F.lit(False)))
    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(names, pairs)), lambda p: F.length(p["old"]) > 1)), lambda a, b: F.when(F.length(a["old"]) != F.length(b["old"]), F.length(b["old"]) - F.length(a["old"])).when(a["old"] < b["old"], -1).when(a["old"] > b["old"], 1).otherwise(0))


def _carried(gap: Column, mentions: Column, pattern: Column) -> Column:
    """A piece of text between entities with the untitled names of ``mentions`` replaced."""
    new = F.transform(F.regexp_extract_all(gap, pattern, F.lit(0)), lambda x: F.filter(mentions, lambda p: p["old"] == x)[0]["new"])
    parts = F.arrays_zip(F.split(gap, pattern, -1).alias("gap"), F.concat(new, F.array(F.lit(""))).alias("end"))
    return F.array_join(F.transform(parts, lambda z: F.concat(z["gap"], z["end"])), "")


def rewritten(docs: DataFrame, key: str = KEY) -> DataFrame:
    """The columns of ``docs`` as ``places`` names them, with the text rewritten, and _n and _kinds: how many entities, of which kinds."""
    docs = docs.select(*places(docs), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_name"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("_sha"))
    names = [n for n in docs.columns if not n.startswith("_")]
    redrawn = _redrawn(docs, key)
    if redrawn is not None:
        small = redrawn.count() <= MOST_BROADCAST
        docs = docs.join(F.broadcast(redrawn) if small else redrawn, ["_name", "_sha"], "left")

    def drawn(x):
        first = surrogate(x["kind"], x["norm"], F.lit(0), key)
        return first if redrawn is None else F.coalesce(F.element_at("_redrawn", _digest(x["kind"], x["norm"], key)), first)

    docs = docs.withColumn("_found", F.coalesce(_found(F.col("text")), F.array().cast("array<struct<e:string,kind:string,norm:string>>")))
    docs = docs.withColumn("_drawn", F.transform("_found", drawn))
    docs = docs.withColumn("_mentions", _mentions(F.col("_found"), F.col("_drawn")))
    quoted = F.array_join(F.transform("_mentions", lambda p: F.concat(F.lit("\\Q"), p["old"], F.lit("\\E"))), "|")
    docs = docs.withColumn("_pattern", F.concat(F.lit(r"(?<![\p{L}\p{M}])(?:"), quoted, F.lit(r")(?![\p{L}\p{M}])")))
    new = F.transform(F.arrays_zip("_found", "_drawn"), lambda z: let(z["_found"], lambda x: F.when(x["kind"].isNull(), x["e"]).otherwise(F.coalesce(rendered(x["kind"], x["e"], z["_drawn"]), x["e"]))))
    parts = F.arrays_zip(F.split("text", PATTERN, -1).alias("gap"), F.concat(new, F.array(F.lit(""))).alias("end"))
    gap = lambda z: F.when(F.size("_mentions") > 0, _carried(z["gap"], F.col("_mentions"), F.col("_pattern"))).otherwise(z["gap"])
    whole = F.array_join(F.transform(parts, lambda z: F.concat(gap(z), z["end"])), "")
    text = F.when(F.size("_found") > 0, whole).otherwise(F.col("text")).alias("text")
    kinds = F.filter("_found.kind", lambda k: k.isNotNull())  # none: a long number that isn't a card
    return docs.select(*[text if n == "text" else F.col(n) for n in names], F.size(kinds).cast("long").alias("_n"), F.array_sort(F.array_distinct(kinds)).alias("_kinds"))


def surrogated(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with its ``text`` rewritten, and n_found and kinds of the detected entities."""
    kept = [(c, n) for c, n in zip(renamed(docs, docs.columns), docs.columns, strict=True) if n not in ("n_found", "kinds")]
    return rewritten(docs, key).select(*[c for c, _ in kept], F.col("_n").alias("n_found"), F.col("_kinds").alias("kinds"))


def private(docs: DataFrame, key: str = KEY) -> DataFrame:
    """The columns of ``docs`` with its ``text`` rewritten; an n_chars follows the text where that changed."""
    found = rewritten(docs, key)
    size = lambda c: F.when(F.col("_n") > 0, F.length("text").cast("long")).otherwise(c).alias("n_chars")
    return found.select(*[size(F.col(f"c{k}")) if n == "n_chars" else c for k, (c, n) in enumerate(zip(renamed(docs, docs.columns), docs.columns, strict=True))])


def op7(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return surrogated(docs)
