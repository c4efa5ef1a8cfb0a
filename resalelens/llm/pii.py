"""PII surrogates: detected entities get keyed, type-consistent replacements.

Detected: e-mail addresses, IPv4 addresses, payment-card and other 13-19 digit
numbers, phone numbers, quoted secrets (20 or more characters with a digit)
and titled personal names.  Every distinct entity (in a canonical form, so
that ``A.B@x.org`` and ``a.b@x.org``, or one phone number in two notations,
are one) is given one surrogate for the whole corpus:

* characters keep their class: digits stay digits, letters letters of the same
  case and script; punctuation, grouping, lengths, the top-level domain, the
  first digit of a number and the validity of a card's check digit are kept;
* names get invented names of the same script (Latin, Cyrillic), given names of
  the gender the title says; the surname of ``Mr A B`` and ``Mr B`` is one entity.

Surrogates derive from SHA-256 of a secret key and the entity.  A *collision
check* over all distinct entities gives a surrogate that two entities share,
or that is itself an entity of the corpus, to at most one entity (never in the
latter case); the losers try again with the next attempt number until every
surrogate is unique.  Distinct entities thus stay distinct, and equal ones
equal, over all documents.

Texts with entities meet their surrogates by document; each mention is written
in its own notation.  Everything is built-in DataFrame expressions.

Defined results: null texts stay null; texts without entities are returned
unchanged; rows that repeat an (id, text) get the same result; an empty table
gives no rows; other columns are not returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resalelens.llm.common import KeyFilter, let, stored

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_MALE = "Mr|Herr|Monsieur|Señor|Господин"
_FEMALE = "Mrs|Ms|Miss|Frau|Madame|Señora|Госпожа"
# A local part has at most 64 characters, a domain 253; nothing longer is an address.
EMAIL = (r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@(?=[\p{L}\p{N}.-]{1,253}+(?![\p{L}\p{N}.-]))"
         r"[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++")
NAME = rf"(?<![\p{{L}}])(?:{_MALE}|{_FEMALE})\.?\x20\p{{Lu}}\p{{Ll}}+(?:\x20\p{{Lu}}\p{{Ll}}+)?"
IP = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"
NUMBER = r"(?<![\d])\d(?:[\x20-]?\d){12,18}(?!\d)"
PHONE = r"(?<![\p{L}\d+])(?:\+\d{1,3}[\x20.-]?)?(?:\(\d{2,4}\)[\x20.-]?|\d{2,4}[\x20.-])\d{3,4}[\x20.-]\d{3,4}(?!\d)"
SECRET = r"(?<=[\"'])(?=[A-Za-z+/_=-]*\d)[A-Za-z0-9+/_=-]{20,}(?=[\"'])"
ANY = "|".join([EMAIL, NAME, IP, NUMBER, PHONE, SECRET])
KEY = "resale-surrogates"
EXTEND_AT = 6  # attempts after which the surrogate may grow

_LATIN = ["ba", "do", "fe", "gi", "ka", "lo", "mi", "ne", "pa", "ro", "sa", "te", "vi", "ze", "al", "er"]
_CYRILLIC = ["ба", "до", "фе", "ги", "ка", "ло", "ми", "не", "па", "ро", "са", "те", "ви", "зе", "ал", "ер"]
_ENDS = {"given_m": (["n", "s", "k", "rd"], ["н", "р", "к", "м"]),
         "given_f": (["na", "la", "ra", "sa"], ["на", "ла", "ра", "са"]),
         "surname": (["mann", "son", "er", "ini"], ["ов", "ин", "ский", "енко"])}


def _kind(m: Column) -> Column:
    return (F.when(F.contains(m, F.lit("@")), "email")
            .when(F.rlike(m, F.lit("^" + NAME.split(")", 1)[1] + "$")), "name")
            .when(F.rlike(m, F.lit(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$")), "ip")
            .when(F.rlike(m, F.lit(r"^\d(?:[\x20-]?\d){12,18}$")), "number")
            .when(F.rlike(m, F.lit(r"^[+(]?\d[\d\x20.()-]*$")), "phone")
            .otherwise("secret"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def _entities(mention: Column, kind: Column) -> Column:
    """Array of (kind, canon) of a mention: one, or given name and surname."""
    def one(k: Column, c: Column) -> Column:
        return F.struct(k.alias("kind"), c.alias("canon"))

    names = F.split(F.lower(F.regexp_replace(mention, r"^\S+\x20", "")), " ")
    gender = F.when(F.rlike(mention, F.lit(rf"^(?:{_FEMALE})(?!\p{{L}})")), "given_f").otherwise("given_m")
    return (F.when(kind == "name", F.when(F.size(names) == 1, F.array(one(F.lit("surname"), names[0])))
                   .otherwise(F.array(one(gender, F.get(names, F.lit(0))), one(F.lit("surname"), F.get(names, F.lit(1))))))
            .when(kind == "email", F.array(one(kind, F.lower(mention))))
            .when(kind.isin("number", "phone"), F.array(one(kind, _digits(mention))))
            .otherwise(F.array(one(kind, mention))))


def _luhn(d: Column) -> Column:
    """Luhn sum (mod 10) of a digit string."""
    n = F.length(d)

    def digit(c: Column, i: Column) -> Column:
        v = c.cast("int")
        twice = v * 2
        return F.when((n - i) % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(v)

    return F.aggregate(F.transform(F.split(d, ""), digit), F.lit(0), lambda s, x: s + x) % 10


def surrogate(kind: Column, canon: Column, attempt: Column, key: str = KEY) -> Column:
    """The surrogate (canonical form) of one entity at one attempt."""
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), canon), 256)
    return let(seed, lambda s: _surrogate(kind, canon, attempt, s))


def _surrogate(kind: Column, canon: Column, attempt: Column, s: Column) -> Column:
    def r(i, m: int) -> Column:
        return F.pmod(F.xxhash64(s, i if isinstance(i, Column) else F.lit(i)), F.lit(m)).cast("int")

    tld = F.length(canon) - F.instr(F.reverse(canon), ".") + 1  # place of the last dot

    hexed = (kind == "secret") & F.rlike(canon, F.lit("^[0-9a-f]+$"))

    def char(c: Column, i: Column) -> Column:
        return (F.when((kind == "email") & (i + 1 > tld), c)
                .when(F.rlike(c, F.lit("[0-9]")), r(i, 10).cast("string"))
                .when(F.rlike(c, F.lit("[A-Z]")), F.char(r(i, 26) + 65))
                .when(F.rlike(c, F.lit(r"\p{IsCyrillic}")), F.substring(F.lit("абвгдежзиклмнопрстуфхцчшщыэюя"), r(i, 29) + 1, F.lit(1)))
                .when(hexed, F.char(r(i, 6) + 97))
                .when(F.rlike(c, F.lit(r"\p{L}")), F.char(r(i, 26) + 97)).otherwise(c))

    extra = F.when(attempt >= EXTEND_AT, F.substring(s, 1, 12)).otherwise("")
    chars = F.concat(F.when(kind == "email", extra).otherwise(""),
                     F.array_join(F.transform(F.split(canon, ""), char), ""), F.when(kind == "secret", extra).otherwise(""))
    # Digit strings of one length and first digit can run out: later attempts are longer.
    digits = F.greatest(F.length(canon), F.lit(2)) + F.when(attempt >= EXTEND_AT, attempt - EXTEND_AT + 2).otherwise(0)
    raw = F.concat(F.substring(canon, 1, 1),
                   F.array_join(F.transform(F.sequence(F.lit(2), digits), lambda i: r(i, 10).cast("string")), ""))
    # A valid check digit stays valid.
    body = F.substring(raw, F.lit(1), F.length(raw) - 1)
    check = (10 - _luhn(F.concat(body, F.lit("0")))) % 10
    number = F.when((kind == "number") & (_luhn(canon) == 0), F.concat(body, check.cast("string"))).otherwise(raw)
    ip = F.concat_ws(".", *[(r(i, 254) + 1).cast("string") for i in range(4)])

    def name(k: str) -> Column:
        def of(syllables: list[str], ends: list[str]) -> Column:
            pick = F.array(*[F.lit(x) for x in syllables])
            n = 3 if k == "surname" else 2
            more = F.when(attempt >= EXTEND_AT, F.concat(*[F.get(pick, r(20 + i, len(syllables))) for i in range(6)])).otherwise("")
            return F.concat(*[F.get(pick, r(i, len(syllables))) for i in range(n)], more,
                            F.get(F.array(*[F.lit(x) for x in ends]), r(9, len(ends))))

        return F.when(F.rlike(canon, F.lit(r"^\p{IsCyrillic}")), of(_CYRILLIC, _ENDS[k][1])).otherwise(of(_LATIN, _ENDS[k][0]))

    out = F.when(kind == "ip", ip).when(kind.isin("number", "phone"), number)
    for k in _ENDS:
        out = out.when(kind == k, name(k))
    return out.otherwise(chars)


def assign(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, canon, surrogate): unique surrogates, none an entity itself.

    ``entities`` has distinct (kind, canon).  Rounds until no collision is left.
    """
    todo = entities.withColumn("attempt", F.lit(0))
    done = None
    while True:
        tried = todo.withColumn("surrogate", surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key))
        best = tried.groupBy("kind", "surrogate").agg(F.min("canon").alias("best"))
        real = entities.select("kind", F.col("canon").alias("surrogate")).withColumn("taken", F.lit(True))
        if done is not None:
            real = real.unionByName(done.select("kind", "surrogate").withColumn("taken", F.lit(True)))
        round_ = stored(tried.join(best, ["kind", "surrogate"]).join(real, ["kind", "surrogate"], "left")
                        .select("kind", "canon", "attempt", "surrogate", (F.col("taken").isNull() & (F.col("canon") == F.col("best"))).alias("won"))
                        .distinct(), "surrogates")
        won = round_.where("won").select("kind", "canon", "surrogate")
        done = won if done is None else done.unionByName(won)
        todo = round_.where("not won").select("kind", "canon", (F.col("attempt") + 1).alias("attempt"))
        if todo.isEmpty():
            return done


def _written(mention: Column, kind: Column, surrogates: Column) -> Column:
    """The mention in its own notation with its entities' surrogates."""
    one = F.get(surrogates, F.lit(0))

    def digit(c: Column, i: Column) -> Column:
        before = F.length(_digits(F.substring(mention, F.lit(1), i)))
        return F.when(F.rlike(c, F.lit(r"\d")), F.substring(one, before + 1, F.lit(1))).otherwise(c)

    def cased(c: Column, i: Column) -> Column:
        s = F.substring(one, i + 1, F.lit(1))
        return F.when(F.rlike(c, F.lit(r"\p{Lu}")), F.upper(s)).otherwise(s)

    same_length = F.length(one) == F.length(mention)
    return (F.when(kind == "name", F.concat_ws(" ", F.regexp_extract(mention, r"^\S+", 0),
                                               F.array_join(F.transform(surrogates, lambda x: F.initcap(x)), " ")))
            .when(kind.isin("number", "phone"), F.concat(
                F.array_join(F.transform(F.split(mention, ""), digit), ""),
                F.substring(one, F.length(_digits(mention)) + 1, F.length(one))))
            .when((kind == "email") & same_length, F.array_join(F.transform(F.split(mention, ""), cased), ""))
            .otherwise(one))


def mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, no, mention, kind): every detected mention, in text order."""
    text = F.col(text_col).cast("string")
    return (docs.where(F.rlike(text, F.lit(rf"[0-9@]|(?:{_MALE}|{_FEMALE})")))
            .select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                    F.posexplode(F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).alias("no", "mention"))
            .withColumn("kind", _kind(F.col("mention"))))


def replace_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY) -> DataFrame:
    """One row per document: doc_id, text with surrogates, n_entities (mentions replaced)."""
    found = stored(mentions(docs, id_col, text_col).distinct(), "mentions")
    unit = found.select("mention", "kind").distinct().select(
        "mention", "kind", F.posexplode(_entities(F.col("mention"), F.col("kind"))).alias("p", "e"))
    mapping = assign(stored(unit.select("e.kind", "e.canon").distinct(), "entities"), key)
    written = (unit.select("mention", F.col("kind").alias("m_kind"), "p", F.col("e.kind").alias("kind"), F.col("e.canon").alias("canon"))
               .join(mapping, ["kind", "canon"])
               .groupBy("mention", "m_kind").agg(F.sort_array(F.collect_list(F.struct("p", "surrogate"))).alias("s"))
               .select(F.col("mention").alias("w_mention"), _written(F.col("mention"), F.col("m_kind"), F.col("s.surrogate")).alias("new")))
    by_doc = (found.join(written, F.col("mention") == F.col("w_mention"))
              .groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("no", "new"))).alias("r"))
              .select(F.col("doc_id").alias("r_id"), F.col("text_hash").alias("r_hash"), F.col("r.new").alias("r")))
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    # Texts without any mention are not shuffled.
    by_doc = stored(by_doc, "replacements")
    touched = KeyFilter(by_doc, F.col("r_hash"), by_doc.count())
    joined = (touched.maybe(rows, F.col("text_hash"))
              .join(by_doc, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_hash") == F.col("r_hash")), "left")
              .select("doc_id", "text", "r")
              .unionByName(touched.surely_not(rows, F.col("text_hash"))
                           .select("doc_id", "text", F.lit(None).cast("array<string>").alias("r"))))
    rebuilt = F.array_join(F.flatten(F.zip_with(F.split(text, ANY, -1), "r",
                                                lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    return joined.select("doc_id", F.when(F.col("r").isNull(), text).otherwise(rebuilt).alias("text"),
                         F.coalesce(F.size("r"), F.lit(0)).cast("long").alias("n_entities"))
