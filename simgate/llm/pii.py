"""Surrogates for personal data, with DataFrame functions alone.

Entities (mail addresses, telephone numbers, payment cards, IP addresses, social security and account
numbers, secrets after a keyword, keys of known form, logins in addresses of sites, names after a
title) are found by one pattern. Each distinct entity, in a normal form without case and punctuation (a
name also by its gender, so that a woman and a man of one name are two), gets a replacement from a keyed digest of it: digits for digits, letters for letters of the same
script, hexadecimal for hexadecimal, octets for octets, a check digit where the original has one, a
name of the gender that the title tells. The same entity has the same replacement everywhere
(coreference). Replacements that two entities share, or that are an entity of the corpus themselves,
are drawn again with the next attempt number until all are distinct. Punctuation and case of each
mention stay.

Titles and keywords are found in any case, and a keyword also behind other characters (client_secret,
accessToken), which stay. A name is what has capitals behind a title, up to three words (where all is
in capitals, that can take in a word after the name), or up to two words of a script without capitals,
or Han characters before a Chinese title. A name of two words or more is also found without a title, in any
case, in the documents that have it with one; single words and parts of names without a title are not. A name
without a title, or with one that tells no gender, has the gender of its first mention in the document that tells
one, else of the corpus (where that has both, female), else a given name of either kind. A password is also found
behind "is" where it has a digit.

Only rows with entities are joined; their text, equal ones once, moves by its digest.

Defined results: a null text stays null and an empty one empty, with no entities; an entity that
overlaps another is the one that begins first; repeated rows give repeated rows; null ids and all
other columns are kept as they are; where n_entities is taken, the count is n_entities_2 (and so on);
texts are searched whole. The key has no default: whoever has it can test guesses of an original.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simgate.llm.shared import discard, written
from simgate.llm.tables import documents

#: Setting of the session that holds the key of registered queries, and what they take without it.
KEY_SETTING, DEMO_KEY = "spark.simgate.surrogate.key", "demonstration"

#: What stands before a name (by gender) or behind it, before a secret, and how keys of known form begin.
MALE_TITLES = "(?iu:Mr|Mister|Herr|Monsieur|Señor|Господин)"
FEMALE_TITLES = "(?iu:Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа)"
NEUTRAL_TITLES = "(?iu:Dr|Doctor|Doktor|Docteur|Prof|Professor|Professeur)"
HAN_TITLES = "先生|女士|小姐"
SECRET_WORDS = "(?i:token|secret|password|passwd|api_key|apikey|access_key)"
IS = r"\s{1,2}(?i:is|ist|es|est)\s{1,2}"
KEY_STARTS = "AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-|AIza|eyJ"

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Kind and pattern, in order of preference at one place. No group captures. A secret's match begins
#: with its keyword and a name's with its title; both stay.
PATTERNS = {
    "secret": rf"(?:{SECRET_WORDS})(?:\s{{0,2}}[=:]\s{{0,2}}[\"']?|{IS}[\"']?(?=[A-Za-z_/+=-]*\d))(?=(?:\.?[A-Za-z0-9_/+=-]){{8}})[A-Za-z0-9_/+-][A-Za-z0-9_/+=-]*(?:\.[A-Za-z0-9_/+=-]+)*",
    "name": rf"(?:{MALE_TITLES}|{FEMALE_TITLES}|{NEUTRAL_TITLES})\.?\s(?:\p{{Lu}}[\p{{L}}'’-]+(?: (?!(?:{MALE_TITLES}|{FEMALE_TITLES}|{NEUTRAL_TITLES})\.?\s)\p{{Lu}}[\p{{L}}'’-]+){{0,2}}|\p{{IsHan}}{{2,4}}|[\p{{Lo}}\p{{M}}&&[^\p{{IsHan}}]]{{2,20}}(?: [\p{{Lo}}\p{{M}}&&[^\p{{IsHan}}]]{{2,20}})?)",
    "login": r"://[^\s:@/]{1,64}:[^\s@/]{1,128}@",
    "key": r"(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*)(?![A-Za-z0-9_-])",
    "mail": r"[\p{L}\p{N}._%+-]{1,64}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": rf"{OCTET}(?:\.{OCTET}){{3}}(?!\.?\d)",
    "ip6": r"(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "ssn": r"\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"\d(?:[ -]?\d){12,18}(?!\d)",
    "phone": r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|\+\d{1,3}(?:[ .-]?\d){7,12}(?!\d)|0\d{2,4}[ -]\d{3,4}[ -]\d{3,4}(?![\d-])|[2-9]\d{9}(?!\d)",
    "account": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
}
#: Only secrets' keywords, logins and Han names begin inside of words or numbers, so most places are passed by their first test.
INSIDE = rf"(?=[tspaTSPA]){PATTERNS['secret']}|(?=:){PATTERNS['login']}|\p{{IsHan}}{{2,3}}(?={HAN_TITLES})"
ANY = rf"(?:{INSIDE}|(?<![\p{{L}}\p{{N}}._%+-])(?=[\p{{L}}\p{{N}}._%+(-])(?:" + "|".join(p for k, p in PATTERNS.items() if k not in ("secret", "login")) + "))"
BEFORE = rf"^(?:(?:{SECRET_WORDS})(?:\s{{0,2}}[=:]\s{{0,2}}|{IS})[\"']?|(?:{MALE_TITLES}|{FEMALE_TITLES}|{NEUTRAL_TITLES})\.?\s|://|{KEY_STARTS})"

#: First letter and number of letters of scripts, by the name that patterns have for them.
SCRIPTS = {
    "Greek": (0x3B1, 17), "Cyrillic": (0x430, 32), "Armenian": (0x561, 38), "Georgian": (0x10D0, 33), "Hebrew": (0x5D0, 27), "Arabic": (0x628, 19),
    "Devanagari": (0x915, 37), "Thai": (0xE01, 46), "Hiragana": (0x304B, 20), "Katakana": (0x30AB, 20), "Hangul": (0xAC00, 11_000), "Han": (0x4E00, 4_000),
}

#: Parts of replacement names by script.
NAMES = {
    "latin": {
        "male": "Adam Bruno Carl David Emil Felix Gustav Henry Ivan Jonas Karl Leo Martin Noel Oscar Paul".split(),
        "female": "Anna Berta Clara Diana Emma Flora Greta Helen Irene Julia Karen Laura Maria Nora Olga Paula".split(),
        "family": "bar del fen gor hal kel lan mor nev per rol sen tor van wen zim".split(),
    },
    "cyrillic": {
        "male": "Антон Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Максим Никита Олег Павел Роман Семён".split(),
        "female": "Анна Белла Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лидия Мария Нина Ольга Полина Раиса".split(),
        "family": "бар дел фен гор хал кел лан мор нев пер рол сен тор ван вен зим".split(),
    },
}


def kind_of(mention: Column) -> Column:
    """The first kind whose pattern all of the mention has; what has none is a name without a title before it."""
    whole = {k: f"^(?:{p})$" for k, p in PATTERNS.items()}
    return reduce(lambda rest, k: F.when(mention.rlike(whole[k]), F.lit(k)).otherwise(rest), reversed(whole), F.lit("name"))


def normal(kind: Column, entity: Column) -> Column:
    compact = F.regexp_replace(entity, r"[^\p{L}\p{N}]", "")
    return F.when(kind.isin("phone", "card", "ssn", "account"), F.upper(compact)).when(kind.isin("secret", "key", "login"), entity).otherwise(F.lower(entity))


def _array(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def drawn(kind: Column, plain: Column, gender: Column, attempt: Column, key: str) -> Column:
    """The replacement of a normal form at an attempt."""
    seed = F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), plain)
    stream = F.array_join(F.transform(F.sequence(F.lit(0), F.expr("length(plain) div 16") + 1), lambda j: F.sha2(F.concat_ws("|", seed, j.cast("string")), 256)), "")
    byte = lambda i: F.conv(F.substr(F.col("stream"), (i * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    at = lambda values, i: F.element_at(_array(values), F.pmod(byte(i), F.lit(len(values))) + 1)

    def other_than(values: list[str], i: Column) -> Column:
        """One of the values that the original does not have, if there is one."""
        left = F.filter(_array(values), lambda v: ~F.col("plain").contains(F.lower(v)))
        return F.coalesce(F.get(left, F.pmod(byte(i), F.greatest(F.size(left), F.lit(1)))), at(values, i))

    digit = lambda i: F.pmod(byte(i), F.lit(10)).cast("string")
    letter = lambda i: F.char(F.pmod(byte(i), F.lit(26)) + 97)
    two = lambda i: F.conv(F.substr(F.col("stream"), (i * 2 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")
    of_script = lambda first, n, i: F.decode(F.unhex(F.lpad(F.hex(F.pmod(two(i), F.lit(n)) + first), 4, "0")), "UTF-16BE")
    hexed = F.col("plain").rlike("^[0-9a-fA-F]+$")

    def like(c: Column, i: Column) -> Column:
        latin = F.when(c.rlike(r"^\p{IsLatin}$"), F.when(c.rlike(r"^\p{Lu}$"), F.upper(letter(i))).otherwise(letter(i))).otherwise(c)
        other = reduce(lambda rest, s: F.when(c.rlike(rf"^[\p{{Is{s}}}&&\p{{L}}]$"), F.when(c.rlike(r"^\p{Lu}$"), F.upper(of_script(*SCRIPTS[s], i))).otherwise(of_script(*SCRIPTS[s], i))).otherwise(rest), SCRIPTS, latin)
        as_hex = F.when(c.rlike("^[A-F]$"), F.upper(F.hex(F.pmod(byte(i), F.lit(16))))).otherwise(F.lower(F.hex(F.pmod(byte(i), F.lit(16)))))
        return F.when((F.col("kind") == "secret") & hexed | (F.col("kind") == "ip6") & c.rlike("^[0-9a-f]$"), as_hex).when(c.rlike("^[0-9]$"), digit(i)).otherwise(other)

    spelled = F.array_join(F.transform(F.split("plain", ""), like), "")
    # a card keeps its first digit, and a right check digit if it had one
    luhn = lambda text, shift: F.aggregate(
        F.transform(F.reverse(F.split(text, "")), lambda c, i: F.when(F.pmod(i + shift, F.lit(2)) == 0, c.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, [0, 2, 4, 6, 8, 1, 3, 5, 7, 9])), c.cast("int") + 1))),
        F.lit(0), lambda a, x: a + x,
    )
    body = F.concat(F.substr("plain", F.lit(1), F.lit(1)), F.substr(spelled, F.lit(2), F.length("plain") - 2))
    card = F.when(F.pmod(luhn(F.col("plain"), 0), F.lit(10)) == 0, F.concat(body, F.pmod(10 - F.pmod(luhn(body, 1), F.lit(10)), F.lit(10)).cast("string"))).otherwise(F.concat(body, F.substr(spelled, F.length("plain"), F.lit(1))))
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.pmod(byte(i), F.lit(254)) + 1).cast("string")), ".")
    phone = F.concat(F.substr("plain", F.lit(1), F.lit(1)), F.substr(spelled, F.lit(2)))
    account = F.concat(F.substr("plain", F.lit(1), F.lit(2)), F.substr(spelled, F.lit(3)))
    local, domain = F.substring_index("spelled", "@", 1), F.substring_index("plain", "@", -1)
    host = F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), domain), 256)  # one for each domain, whoever is at it
    end = F.substring_index(domain, ".", -1)
    mail = F.concat(local, F.lit("@h"), F.substr(host, F.lit(1), F.lit(10)), F.lit(".example."), F.when(end.isin("com", "org", "net"), end).otherwise("org"))
    syllables = F.sequence(F.lit(0), F.lit(2) + F.expr("attempt div 2"))

    def name(script: str) -> Column:
        family = F.initcap(F.array_join(F.transform(syllables, lambda i: at(NAMES[script]["family"], i + 4)), ""))
        female, male = NAMES[script]["female"], NAMES[script]["male"]
        given = lambda i: F.when(F.col("gender") == "female", other_than(female, i)).when(F.col("gender") == "male", other_than(male, i)).otherwise(other_than(female + male, i))
        words = F.size(F.split("plain", " "))
        return F.when(words == 1, family).when(words == 2, F.concat_ws(" ", given(F.lit(0)), family)).otherwise(F.concat_ws(" ", given(F.lit(0)), given(F.lit(1)), family))

    named = F.when(F.col("plain").rlike(r"\p{IsCyrillic}"), name("cyrillic")).when(F.col("plain").rlike(r"\p{IsLatin}"), name("latin")).otherwise(F.initcap("spelled"))
    chosen = F.when(kind == "card", card).when(kind == "ip", octets).when(kind == "phone", phone).when(kind == "account", account).when(kind == "mail", mail).when(kind == "name", named).otherwise(spelled)
    return stream, spelled, chosen


def with_replacement(rows: DataFrame, key: str) -> DataFrame:
    """Add the replacement to (kind, plain, gender, attempt)."""
    stream, spelled, chosen = drawn(F.col("kind"), F.col("plain"), F.col("gender"), F.col("attempt"), key)
    return rows.withColumn("stream", stream).withColumn("spelled", spelled).withColumn("replacement", chosen).select("kind", "plain", "gender", "attempt", "replacement")


def dictionary(entities: DataFrame, key: str) -> DataFrame:
    """A table of (kind, plain, gender, replacement) and more, with distinct replacements, none of which is an entity itself."""
    rows = written(with_replacement(entities.withColumn("attempt", F.lit(0)), key), "replacements")
    while True:
        same = F.lower("replacement").alias("form")
        one = F.struct("attempt", "plain", F.coalesce("gender", F.lit("")).alias("gender"))
        owners = rows.groupBy("kind", same).agg(F.min(one).alias("owner"))
        real = entities.select("kind", F.lower("plain").alias("form")).distinct().withColumn("real", F.lit(True))
        judged = rows.withColumn("form", F.lower("replacement")).join(owners, ["kind", "form"]).join(real, ["kind", "form"], "left")
        clash = (one != F.col("owner")) | F.col("real").isNotNull()
        judged = written(judged.select("kind", "plain", "gender", "attempt", "replacement", clash.alias("clash")), "judged")
        discard(rows)
        if judged.where("clash").isEmpty():
            return judged
        again = with_replacement(judged.where("clash").withColumn("attempt", F.col("attempt") + 1), key)
        rows = written(judged.where("NOT clash").select(*again.columns).union(again), "replacements")
        discard(judged)


def in_form(kind: Column, form: Column, replacement: Column) -> Column:
    """The replacement with the punctuation and case of a mention."""
    step = lambda acc, c: F.when(c.rlike(r"^[\p{L}\p{N}]$"), F.struct(F.concat(acc["out"], F.substr(replacement, acc["k"] + 1, F.lit(1))).alias("out"), (acc["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["k"].alias("k")))
    filled = F.aggregate(F.split(form, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("k")), step, lambda acc: acc["out"])
    cased = F.when(form == F.upper(form), F.upper(replacement)).otherwise(replacement)
    return F.when(kind.isin("phone", "card", "ssn", "account"), filled).when(kind.isin("mail", "name"), cased).otherwise(replacement)


def with_gender(told: DataFrame) -> DataFrame:
    """Mentions with the gender of their entity; empty where nothing tells one."""
    open_ = (F.col("kind") == "name") & F.col("gender").isNull()
    titled = told.where((F.col("kind") == "name") & F.col("gender").isNotNull())
    here = titled.groupBy("digest", "plain").agg(F.min_by("gender", "k").alias("here"))
    anywhere = titled.groupBy("plain").agg(F.min("gender").alias("anywhere"))
    found = told.where(open_).join(here, ["digest", "plain"], "left").join(anywhere, "plain", "left").withColumn("gender", F.coalesce("here", "anywhere", F.lit("")))
    return told.where(~open_).withColumn("gender", F.coalesce("gender", F.lit(""))).unionByName(found.select(*told.columns))


def surrogates(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """df with its text's entities replaced, and their number as the last column, n_entities; other columns stay."""
    own = [c for c in df.columns if c != text_col]
    counted = next(n for n in ("n_entities", *(f"n_entities_{i}" for i in range(2, len(own) + 3))) if n not in own)
    found = F.regexp_extract_all("text", F.lit(ANY), F.lit(0))
    scanned = df.select(*(F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(own)), F.col(f"`{text_col}`").cast("string").alias("text"))
    scanned = scanned.withColumn("found", found).withColumn("found", F.when(F.size("found") > 0, F.col("found")))
    scanned = written(scanned.withColumn("digest", F.when(F.col("found").isNotNull(), F.sha2(F.col("text").cast("binary"), 256))), "scanned")
    hits = scanned.where("found IS NOT NULL").groupBy("digest").agg(F.first("text").alias("text"), F.first("found").alias("found"))  # equal texts once
    titled = F.transform(F.filter("found", lambda m: m.rlike(f"^(?:{PATTERNS['name']})$")), lambda m: F.regexp_replace(m, BEFORE, ""))
    names = F.array_sort(F.array_distinct(F.filter(titled, lambda m: m.contains(" "))), lambda a, b: F.length(b) - F.length(a))
    hits = hits.withColumn("names", names).withColumn("pattern", F.when(F.size("names") > 0, F.concat(F.lit(ANY + r"|(?<![\p{L}\p{N}])(?iu:"), F.array_join("names", "|"), F.lit(r")(?![\p{L}\p{N}])"))))
    once = hits.where("pattern IS NULL").select("digest", "found", F.split("text", ANY).alias("gaps"))
    twice = hits.where("pattern IS NOT NULL").select("digest", F.regexp_extract_all("text", F.col("pattern"), F.lit(0)).alias("found"), F.split("text", F.col("pattern")).alias("gaps"))
    hits = written(once.union(twice), "hits")
    mentions = hits.select("digest", F.posexplode("found").alias("k", "mention"))
    parts = {"before": F.regexp_extract("mention", BEFORE, 0), "kind": kind_of(F.col("mention"))}
    mentions = mentions.select("digest", "k", "mention", *(v.alias(k) for k, v in parts.items()))
    mentions = mentions.withColumn("before", F.when(F.col("kind").isin("secret", "name", "login", "key"), F.col("before")).otherwise(""))
    mentions = mentions.withColumn("form", F.substr("mention", F.length("before") + 1)).withColumn("plain", normal(F.col("kind"), F.col("form")))
    gender = F.when(F.col("before").rlike(rf"^({FEMALE_TITLES})\.?\s$"), "female").when(F.col("before").rlike(rf"^({MALE_TITLES})\.?\s$"), "male")
    told = written(mentions.select("digest", "k", "before", "form", "kind", "plain", gender.alias("gender")), "told")
    mentions = written(with_gender(told), "mentions")
    discard(told)
    entities = written(mentions.groupBy("kind", "plain", "gender").agg(F.count(F.lit(1)).alias("n")).drop("n"), "entities")
    chosen = dictionary(entities, key)
    placed = mentions.join(chosen.select("kind", "plain", "gender", "replacement"), ["kind", "plain", "gender"]).withColumn("put", F.concat("before", in_form(F.col("kind"), F.col("form"), F.col("replacement"))))
    lists = placed.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("k", "put"))).alias("puts"))
    pieces = F.zip_with("gaps", F.transform("puts", lambda p: p["put"]), lambda gap, put: F.concat(gap, F.coalesce(put, F.lit(""))))
    changed = written(hits.join(lists, "digest").select("digest", F.array_join(pieces, "").alias("changed"), F.size("found").alias("n")), "changed")  # a table, so that the join can split common texts
    discard(hits, mentions, entities, chosen)
    mine = [f"own_{i}" for i in range(len(own))]
    with_entities = scanned.where("found IS NOT NULL").select(*mine, "digest").join(changed, "digest").select(*mine, F.col("changed").alias("text"), "n")
    without = scanned.where("found IS NULL").select(*mine, "text", F.lit(0).alias("n"))
    columns = {c: F.col(f"own_{i}") for i, c in enumerate(own)} | {text_col: F.col("text")}
    return with_entities.union(without).select(*(columns[c].alias(c) for c in df.columns), F.col("n").alias(counted))


def session_key(spark: SparkSession) -> str:
    """The key that the session sets; where it sets none a demonstration key, with a warning: whoever reads this file has it too."""
    key = spark.conf.get(KEY_SETTING, None)
    if key is None:
        warnings.warn(f"{KEY_SETTING} is not set: surrogates are drawn with the demonstration key", stacklevel=2)
    return key or DEMO_KEY


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates(documents(spark, sf_dir), session_key(spark)).select("doc_id", "text", "n_entities")
