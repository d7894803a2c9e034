"""Surrogates for personal data: keyed, of the same type and form, distinct and consistent.

Every entity found in a text is replaced by another one of its type: titled
names by names of the same gender and script, numbers by numbers with the same
grouping and valid check digits, mail addresses with the same shape. The choice
follows from a key and the entity in a normal form, so all mentions of an entity
get the same surrogate in every document, whatever their spelling. Family names and
given names are entities of their own, so ``Mr. John Smith`` and ``Mr. Smith`` keep one
family name. The distinct entities of the whole table are checked against each
other: two never share a surrogate, and no surrogate is itself an entity of the
table. Those that collide draw again.

Names are found behind a title of the list below. Scripts are Latin, Cyrillic and
Greek; names in another one get Latin surrogates.

All steps are SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.staging import stage

KEY = "tidemark"

_MALE = "Mr|Herr|Monsieur|Señor|Г-н|г-н"
_FEMALE = "Mrs|Ms|Frau|Madame|Señora|Г-жа|г-жа"
_TITLE = rf"(?<!\p{{L}})(?:{_MALE}|{_FEMALE})\.? "
_LABEL = r"(?i:password|passwd|api_key|secret|token) {0,2}[=:] {0,2}\"?"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"

#: Pattern of each type; the first that matches at a place counts.
PATTERNS = {
    "email": r"(?<![\w.%+\-])[A-Za-z0-9._%+\-]++@(?:[A-Za-z0-9\-]++\.)+[A-Za-z]{2,}",
    "secret": rf"(?<![A-Za-z0-9])AKIA[0-9A-Z]{{16}}(?![A-Za-z0-9])|(?<![A-Za-z]){_LABEL}[A-Za-z0-9_\-]{{6,}}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "phone": r"(?<![\d+])\+\d{1,3}[ .\-]?\(?\d{2,4}\)?(?:[ .\-]?\d{2,4}){2,3}(?!\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "card": r"(?<!\d)(?:\d[ \-]?){12,18}\d(?!\d)",
    "name": rf"{_TITLE}\p{{Lu}}[\p{{L}}'’\-]+(?: \p{{Lu}}[\p{{L}}'’\-]+)?",
}
PATTERN = "|".join(PATTERNS.values())

# Given names by gender and script, and family names by script.
_NAMES = {
    "m_latin": "James Thomas Martin Daniel Simon Victor Oscar Felix Hugo Leon Marco Pablo Erik Adam Nils Louis".split(),
    "f_latin": "Anna Clara Julia Laura Sofia Elena Marta Alice Nina Eva Irene Sarah Paula Emma Lucia Helen".split(),
    "m_cyrillic": "Иван Пётр Андрей Сергей Павел Николай Олег Юрий".split(),
    "f_cyrillic": "Анна Мария Ольга Елена Ирина Вера Нина Юлия".split(),
    "m_greek": "Γιώργος Νίκος Κώστας Γιάννης Πέτρος Μιχάλης Ανδρέας Σπύρος".split(),
    "f_greek": "Μαρία Ελένη Σοφία Άννα Κατερίνα Ειρήνη Δήμητρα Χριστίνα".split(),
    "latin": "Keller Novak Moreau Lindgren Costa Weber Marsh Holloway Duval Serrano Brandt Fischer Vidal Ashford Romano Keane".split(),
    "cyrillic": "Орлов Соколов Морозов Волков Зайцев Белов Громов Титов".split(),
    "greek": "Παππάς Νικολάου Δήμου Ραφτό Καλαμάς Βλάχος Λάμπρου Ζαφείρη".split(),
}
_SYLLABLES = {"latin": "berg man sen ton ley field wood ford".split(), "cyrillic": "ин ский ко ук енко ев ян ич".split(), "greek": "πουλος ίδης άκης έλλης όγλου ιάδης έας άτος".split()}


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *parts), 512)


def _draw(digest: Column, place: Column | int, sides: int) -> Column:
    """A number below ``sides`` from two hex digits of the digest."""
    place = F.lit(place) if isinstance(place, int) else place
    return F.conv(F.substring(digest, (place % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int") % sides


def _pool(names: list[str], digest: Column, place: Column | int) -> Column:
    return F.get(F.array(*map(F.lit, names)), _draw(digest, place, len(names)))


def _chars(text: Column) -> Column:
    return F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda k: F.substring(text, k, F.lit(1))), lambda c: c != "")


def _reshaped(text: Column, digest: Column) -> Column:
    """Every digit and letter replaced by another of its class; letters of hex numbers stay hex."""
    hexadecimal = text.rlike("^[0-9a-f]+$")
    letters = F.when(hexadecimal, F.lit(6)).otherwise(F.lit(26))

    def other(char: Column, place: Column) -> Column:
        letter = _draw(digest, place, 256) % letters
        return (
            F.when(char.rlike("^[0-9]$"), _draw(digest, place, 10).cast("string"))
            .when(char.rlike("^[a-z]$"), F.char(letter + 97))
            .when(char.rlike("^[A-Z]$"), F.char(letter + 65))
            .otherwise(char)
        )

    return F.array_join(F.transform(_chars(text), other), "")


def _with_check_digit(body: Column) -> Column:
    digits = F.array(*[F.lit(str(d)) for d in range(10)])
    return F.concat(body, F.get(F.filter(digits, lambda d: F.call_function("luhn_check", F.concat(body, d))), F.lit(0)))


def _iban(country: Column, account: Column) -> Column:
    def step(rest: Column, char: Column) -> Column:
        value = F.when(char.rlike("[0-9]"), rest * 10 + (F.ascii(char) - 48)).otherwise(rest * 100 + (F.ascii(char) - 55))
        return (value % 97).cast("int")

    rest = F.aggregate(_chars(F.concat(account, country, F.lit("00"))), F.lit(0), step)
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), account)


def _surrogate(kind: Column, normal: Column, key: str, attempt: int) -> Column:
    """Normal form of the surrogate. From the eighth attempt on it is longer than the entity."""
    digest = _digest(F.lit(key), kind, normal, F.lit(str(attempt)))
    longer = max(0, attempt - 7)
    more_digits = F.concat(*[_draw(digest, 40 + k, 10).cast("string") for k in range(longer)]) if longer else F.lit("")
    more_letters = F.concat(*[F.char(_draw(digest, 40 + k, 26) + 97) for k in range(longer)]) if longer else F.lit("")
    digits = F.concat(F.substring(normal, 1, 1), _reshaped(F.substring(normal, F.lit(2), F.length(normal)), digest), more_digits)
    local, domain = F.substring_index(normal, "@", 1), F.substring_index(normal, "@", -1)
    top = F.substring_index(domain, ".", -1)
    labels = F.substring(domain, F.lit(1), F.length(domain) - F.length(top))
    octets = [(_draw(digest, k, 254) + 1).cast("string") for k in range(4)]
    form = F.substring_index(normal, "|", 1)
    name = F.lit(None).cast("string")
    for pool, names in _NAMES.items():
        # Given names are those of the pool as long as they are free; family names have an ending at least.
        gender, _, script = pool.rpartition("_")
        endings = [_pool(_SYLLABLES[script], digest, 2 + k) for k in range(attempt if gender else 1 + attempt)]
        name = F.when(form == pool, F.concat(_pool(names, digest, 0), *endings)).otherwise(name)
    return (
        F.when(kind == "email", F.concat(_reshaped(local, digest), more_letters, F.lit("@"), _reshaped(labels, _digest(F.lit(key), F.lit("domain"), domain)), top))
        .when(kind == "ip", F.concat_ws(".", *octets, *([more_digits] if longer else [])))
        .when(kind == "card", _with_check_digit(F.substring(digits, F.lit(1), F.length(digits) - 1)))
        .when(kind == "iban", _iban(F.substring(normal, 1, 2), F.concat(_reshaped(F.substring(normal, F.lit(5), F.length(normal)), digest), more_digits)))
        .when(kind.isin("given", "family"), F.concat(form, F.lit("|"), name))
        .when(kind == "secret", F.concat(F.when(normal.startswith("AKIA"), F.concat(F.lit("AKIA"), _reshaped(F.substring(normal, F.lit(5), F.length(normal)), digest))).otherwise(_reshaped(normal, digest)), more_letters))
        .otherwise(digits)
    )


def _described(found: DataFrame) -> DataFrame:
    """Add kind, prefix, core, normal form and given name to rows with ``found``; kind is NULL for what is no entity after all.

    The normal form of a name is that of the family name, its last word.
    """
    kind = F.lit(None).cast("string")
    for name in reversed(PATTERNS):
        kind = F.when(F.col("found").rlike(f"^(?:{PATTERNS[name]})$"), name).otherwise(kind)
    rows = found.withColumn("kind", kind)
    prefix = F.when(F.col("kind") == "secret", F.regexp_extract("found", f"^({_LABEL})", 1)).when(F.col("kind") == "name", F.regexp_extract("found", f"^({_TITLE})", 1)).otherwise("")
    rows = rows.withColumn("prefix", prefix)
    rows = rows.withColumn("core", F.substring("found", F.length("prefix") + 1, F.length("found")))
    digits = F.regexp_replace("core", "[^0-9]", "")
    gender = F.when(F.col("prefix").rlike(f"^(?:{_FEMALE})[. ]"), "f").otherwise("m")
    script = F.when(F.col("core").rlike(r"\p{IsCyrillic}"), "cyrillic").when(F.col("core").rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    named = F.col("kind") == "name"
    normal = (
        F.when(F.col("kind") == "email", F.lower("core"))
        .when(F.col("kind").isin("phone", "ssn", "card"), digits)
        .when(F.col("kind") == "iban", F.replace("core", F.lit(" "), F.lit("")))
        .when(named, F.concat(script, F.lit("|"), F.lower(F.substring_index("core", " ", -1))))
        .otherwise(F.col("core"))
    )
    given = F.when(named & F.col("core").contains(" "), F.concat(gender, F.lit("_"), script, F.lit("|"), F.lower(F.substring_index("core", " ", 1))))
    rows = rows.withColumn("normal", normal).withColumn("given", given)
    valid = F.when(F.col("kind") == "card", F.call_function("luhn_check", F.when(F.col("kind") == "card", F.col("normal")).otherwise("0"))).otherwise(F.col("kind").isNotNull())
    return rows.withColumn("kind", F.when(valid, F.col("kind")))


def _overlaid(core: Column, new: Column) -> Column:
    """The new digits and letters in the grouping of the old ones; what is left over follows."""
    def step(state: Column, char: Column) -> Column:
        solid = char.rlike("^[A-Za-z0-9]$")
        return F.struct(
            F.concat(state["text"], F.when(solid, F.substring(new, state["at"], F.lit(1))).otherwise(char)).alias("text"),
            (state["at"] + solid.cast("int")).alias("at"),
        )

    start = F.struct(F.lit("").alias("text"), F.lit(1).alias("at"))
    return F.aggregate(_chars(core), start, step, lambda s: F.concat(s["text"], F.substring(new, s["at"], F.length(new))))


def _written(kind: Column, prefix: Column, core: Column, new: Column) -> Column:
    """A surrogate in the spelling of the mention."""
    plain = F.when(kind.isin("phone", "ssn", "card", "iban"), _overlaid(core, new)).otherwise(new)
    shouting = kind.isin("email", "name") & (core == F.upper(core))
    return F.concat(prefix, F.when(shouting, F.upper(plain)).otherwise(plain))


def choose_surrogates(entities: DataFrame, key: str = KEY, surrogate=_surrogate) -> DataFrame:
    """(kind, normal, new) for distinct entities (kind, normal): all ``new`` differ from each other and from all entities."""
    waiting = stage(entities.select("kind", "normal").distinct(), "entities")
    known, done, attempt = waiting, None, 0
    while True:
        drawn = waiting.withColumn("new", surrogate(F.col("kind"), F.col("normal"), key, attempt))
        drawn = stage(drawn, "drawn")
        first = drawn.groupBy("kind", "new").agg(F.min("normal").alias("normal"))
        taken = known.select(F.col("kind").alias("_kind"), F.lower("normal").alias("_taken"))
        free = first.join(taken, (F.col("kind") == F.col("_kind")) & (F.lower("new") == F.col("_taken")), "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "new"), ["kind", "new"], "left_anti")
        done = stage(free if done is None else done.unionByName(free.select("kind", "new", "normal")), "chosen")
        waiting = stage(waiting.join(done, ["kind", "normal"], "left_anti"), "waiting")
        if waiting.isEmpty():
            return done.select("kind", "normal", "new")
        attempt += 1


def replace_entities(docs: DataFrame, key: str = KEY, surrogate=_surrogate) -> DataFrame:
    """Per input row: doc_id, text with surrogates, and entities, the replaced mentions in order as (kind, old, new).

    Needs doc_id and text; other columns are ignored. A NULL text stays NULL, a
    text without entities stays as it is. Rows that repeat an id, or have none,
    are treated one by one. The same key gives the same surrogates in every run
    over the same entities.
    """
    texts = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    hit = F.coalesce(F.col("text").rlike(PATTERN), F.lit(False))
    plain = texts.filter(~hit).withColumn("entities", F.array().cast("array<struct<kind:string,old:string,new:string>>"))
    cut = stage(
        texts.filter(hit).select(
            F.monotonically_increasing_id().alias("row"), "doc_id", F.split("text", PATTERN, -1).alias("gaps"),
            F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)).alias("found"),
        ), "cut-texts",
    )
    described = _described(cut.select("row", F.posexplode("found").alias("at", "found")))
    mentions = stage(described.withColumn("entity", F.when(F.col("kind") == "name", "family").otherwise(F.col("kind"))), "mentions")
    entities = mentions.filter("kind IS NOT NULL").select(F.col("entity").alias("kind"), "normal")
    entities = entities.unionByName(mentions.filter("given IS NOT NULL").select(F.lit("given").alias("kind"), F.col("given").alias("normal")))
    chosen = choose_surrogates(entities, key, surrogate)
    givens = chosen.filter("kind = 'given'").select(F.col("normal").alias("given"), F.col("new").alias("new_given"))
    joined = mentions.join(chosen.withColumnRenamed("kind", "entity"), ["entity", "normal"], "left").join(givens, "given", "left")
    whole_name = F.concat_ws(" ", F.substring_index("new_given", "|", -1), F.substring_index("new", "|", -1))
    drawn = F.when(F.col("kind") == "name", whole_name).otherwise(F.col("new"))
    new = F.when(F.col("new").isNull(), F.col("found")).otherwise(_written(F.col("kind"), F.col("prefix"), F.col("core"), drawn))
    mention = F.struct("at", "kind", F.col("found").alias("old"), new.alias("new"))
    per_row = joined.groupBy("row").agg(F.sort_array(F.collect_list(mention)).alias("all"))
    whole = cut.select("row", "doc_id", "gaps").join(per_row, "row")
    text = F.array_join(F.transform("gaps", lambda gap, k: F.concat(gap, F.coalesce(F.get("all", k)["new"], F.lit("")))), "")
    replaced = F.filter(F.transform("all", lambda m: F.struct(m["kind"].alias("kind"), m["old"].alias("old"), m["new"].alias("new"))), lambda m: m["kind"].isNotNull())
    return plain.unionByName(whole.select("doc_id", text.alias("text"), replaced.alias("entities")))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for personal data."""
    done = replace_entities(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kinds = F.array_join(F.transform("entities", lambda e: e["kind"]), ",")
    return done.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), kinds.alias("kinds"))


QUERIES = {"op4_pii_surrogates": (op4_pii_surrogates, None)}
