"""Text, taxon, address and search expressions: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: words that stand for an unknown value, genus markers, words left out of name comparison
UNKNOWN = ["", "unknown", "unk", "n/a", "na", "none", "null", "<blank>"]
GENUS_MARKERS = [" sp.", " spp.", " species"]
STOPWORDS = ["a", "and", "mixed", "native", "of", "the", "tree", "trees"]
#: fixed values: street types and leading words spelled out
STREET_TYPES = {
    "ave": "avenue", "av": "avenue", "st": "street", "rd": "road", "dr": "drive", "drv": "drive", "cres": "crescent", "cr": "crescent",
    "crs": "crescent", "pl": "place", "tce": "terrace", "terr": "terrace", "hwy": "highway", "ln": "lane", "ct": "court", "cl": "close",
    "gr": "grove", "gro": "grove", "pde": "parade", "esp": "esplanade", "sq": "square", "blvd": "boulevard", "hts": "heights",
    "wy": "way", "cir": "circle", "crt": "court",
}
STREET_HEADS = {"st": "saint", "mt": "mount", "pt": "point"}
#: fixed values: words of a map search that tell what to do, and words without meaning
INTENT_WORDS = {"show": "on", "display": "on", "add": "on", "on": "on", "enable": "on", "hide": "off", "remove": "off", "off": "off", "without": "off", "disable": "off", "clear": "off", "only": "only", "just": "only"}
SEARCH_STOP = ["the", "a", "an", "of", "to", "for", "me", "please", "map", "layer", "layers", "filter", "filters", "turn", "set", "view", "see", "trees", "tree", "all"]
#: letters with marks and the letters they fold to
MARKED = "àáâãäåāăąçćčďèéêëēĕėęěìíîïīĭįñńňòóôõöøōŏőŕřśšťùúûüūŭůűýÿžÀÁÂÃÄÅĀĂĄÇĆČĎÈÉÊËĒĔĖĘĚÌÍÎÏĪĬĮÑŃŇÒÓÔÕÖŌŎŐŔŘŚŠŤÙÚÛÜŪŬŮŰÝŽ"
PLAIN = "aaaaaaaaacccdeeeeeeeeeiiiiiiinnnooooooooorrsstuuuuuuuuyyzAAAAAAAAACCCDEEEEEEEEEIIIIIIINNNOOOOOOOORRSSTUUUUUUUUYZ"


def let(value: Column, f) -> Column:
    """f(value) with the value computed once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def clean_text(c: Column) -> Column:
    """White space collapsed and trimmed; null for words that mean unknown."""
    t = F.btrim(F.regexp_replace(c.cast("string"), r"\s+", " "))
    return F.when(~F.lower(t).isin(UNKNOWN), t)


def words(c: Column) -> Column:
    """Words of a text in an array; an empty text gives an empty array, null stays null."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def species_confidence(common: Column, latin: Column) -> Column:
    """How far a record's names tell the taxon."""
    k, s = clean_text(common), clean_text(latin)
    low = F.lower(s)
    marked = F.lit(False)
    for m in GENUS_MARKERS:
        marked = marked | low.contains(m)
    return (
        F.when(k.isNull() & s.isNull(), "unknown")
        .when(s.isNotNull() & marked, "source_genus")
        .when(s.isNotNull() & (F.size(words(s)) >= 2), "source_species")
        .when(s.isNotNull(), "source_taxon")
        .otherwise("source_common_only")
    )


def aliased(c: Column, aliases: dict[str, str], default: str = "Unknown") -> Column:
    """Cleaned value, known short forms spelled out, `default` where unknown."""
    t = clean_text(c)
    out = t
    for a, b in aliases.items():
        out = F.when(t == a, b).otherwise(out)
    return F.coalesce(out, F.lit(default))


def name_tokens(c: Column) -> Column:
    """Distinct words of a name without brackets and stop words; an empty array for an unknown name."""
    t = F.regexp_replace(F.lower(clean_text(c)), r"\([^)]*\)", " ")
    w = words(F.regexp_replace(t, r"[^a-z0-9]+", " "))
    return F.coalesce(F.array_distinct(F.filter(w, lambda x: ~x.isin(STOPWORDS))), F.array().cast("array<string>"))


def comparable_phrase(c: Column) -> Column:
    t = F.replace(F.lower(clean_text(c)), F.lit(" tree"), F.lit(""))
    t = F.regexp_replace(F.regexp_replace(t, r"\([^)]*\)", " "), r"[^a-z0-9]+", " ")
    return F.nullif(F.btrim(t), F.lit(""))


def names_compatible(common: Column, latin: Column, other: Column) -> Column:
    """Whether another name can mean the same tree: one phrase within the other, shared words, or the genus."""
    a, b = comparable_phrase(common), comparable_phrase(other)
    ta, tb = name_tokens(common), name_tokens(other)
    both = F.array_intersect(ta, tb)
    phrase = F.coalesce(b.contains(a) | a.contains(b), F.lit(False))
    token = (F.size(ta) > 0) & (F.size(tb) > 0) & (((F.least(F.size(ta), F.size(tb)) == 1) & (F.size(both) == F.size(ta))) | (F.size(both) >= 2))
    genus = F.lower(F.get(words(clean_text(latin)), F.lit(0)))
    in_phrase = F.coalesce(F.array_contains(words(b), genus), F.lit(False))
    return b.isNotNull() & (phrase | token | in_phrase)


def match_confidence(distance: Column, verified: Column, compatible: Column, limits: tuple[float, float, float] = (1.0, 3.0, 8.0)) -> Column:
    """Class of a match by distance, verification and name."""
    return (
        F.when(distance.isNull(), None)
        .when(~F.coalesce(verified, F.lit(False)), "unverified")
        .when(compatible & (distance <= limits[0]), "high")
        .when(compatible & (distance <= limits[1]), "medium")
        .when(compatible & (distance <= limits[2]), "low")
        .otherwise("spatial_only_review")
    )


def flag_label(base: str, flags: list[tuple[Column, Column]]) -> Column:
    """base (flag flag): the labels of the true flags in brackets."""
    got = F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), label) for c, label in flags])), " ")
    return F.when(got != "", F.concat(F.lit(base + " ("), got, F.lit(")"))).otherwise(base)


def taxon_parts(c: Column) -> Column:
    """struct(genus, species, scope) of a Latin name without inventing precision.

    Qualifiers, ranks below the species and quoted cultivars are cut off; 'Genus x epithet' is a hybrid species.
    """
    t = F.btrim(F.regexp_replace(F.replace(c, F.lit("_"), F.lit(" ")), r"\s+", " "), F.lit(" ."))
    known = ~F.lower(t).isin([*UNKNOWN, "-", "?"])
    t = F.regexp_replace(t, r"(?i) (cf\.|aff\.).*$", "")
    t = F.regexp_replace(t, r"(?i) (subsp\.|ssp\.|var\.).*$", "")
    t = F.regexp_replace(t, " ['\"].*['\"]$", "")
    w = words(t)
    one, two, three = (F.get(w, F.lit(i)) for i in range(3))
    genus = F.when(one.rlike("^[A-Z][a-z]+$"), one)
    marker = F.coalesce(F.lower(two).isin("sp", "sp.", "spp", "spp."), F.lit(False))
    hybrid = F.coalesce(two.isin("x", "×"), F.lit(False))
    epithet = F.when(hybrid, three).otherwise(two)
    full = known & genus.isNotNull() & ~marker & F.coalesce(epithet.rlike("^[a-z][a-z-]+$"), F.lit(False))
    species = F.when(full, F.concat(genus, F.when(hybrid, " x ").otherwise(" "), epithet))
    some = F.coalesce(known & genus.isNotNull(), F.lit(False))
    full = F.coalesce(full, F.lit(False))
    scope = F.when(full, "species_exact").when(some, "genus_only").otherwise("unknown")
    return F.struct(F.when(some, genus).alias("genus"), species.alias("species"), scope.alias("scope"))


def taxon_key(c: Column) -> Column:
    """First two words (three for a hybrid) in lower case; null for a genus without epithet."""
    w = words(F.lower(clean_text(c)))
    two = F.get(w, F.lit(1))
    n = F.when(two.isin("x", "×"), 3).otherwise(2)
    return F.when((F.size(w) >= 2) & ~two.rlike(r"^spp?\.?$"), F.array_join(F.slice(w, 1, n), " "))


def genus_of(c: Column) -> Column:
    """First word if it is written like a genus."""
    g = F.get(words(clean_text(c)), F.lit(0))
    return F.when(g.rlike("^[A-Z][a-z]+$"), g)


def display_name(c: Column) -> Column:
    """struct(name, cultivar, several): species name, quoted cultivar, and whether several species are named."""
    t = clean_text(c)
    cultivar = F.nullif(F.regexp_extract(t, "'([^']+)'", 1), F.lit(""))
    name = F.btrim(F.regexp_replace(t, "'[^']*'", ""))
    several = F.coalesce(name.rlike("[,;/&]"), F.lit(False))
    return F.struct(F.nullif(name, F.lit("")).alias("name"), cultivar.alias("cultivar"), several.alias("several"))


def fold(c: Column) -> Column:
    """Marks off letters, lower case."""
    return F.lower(F.translate(c, MARKED, PLAIN))


def norm_text(c: Column) -> Column:
    t = F.regexp_replace(fold(c), "[’'`]", "")
    return F.btrim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def _mapped(c: Column, m: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    return F.coalesce(F.try_element_at(table, c), c)


def norm_street(c: Column) -> Column:
    """Street name with its type and a leading short word spelled out."""

    def spelled(w: Column) -> Column:
        n = F.size(w)
        last = _mapped(F.get(w, n - 1), STREET_TYPES)
        head = _mapped(F.get(w, F.lit(0)), STREET_HEADS)
        middle = F.slice(w, F.lit(2), F.greatest(n - 2, F.lit(0)))
        return F.array_join(F.when(n > 1, F.concat(F.array(head), middle, F.array(last))).otherwise(w), " ")

    return let(words(norm_text(c)), spelled)


def prefix_key(c: Column) -> Column:
    """Key of a prefix shard: the first two letters or digits, filled up with _."""
    k = F.substring(F.regexp_replace(c, "[^a-z0-9]", ""), 1, 2)
    return F.when(F.length(k) == 2, k).when(F.length(k) == 1, F.concat(k, F.lit("_"))).otherwise("__")


def split_number(number: Column, unit: Column) -> Column:
    """struct(number, unit): 2/15A is unit 2, number 15A; a unit given already stays."""
    num = F.replace(F.coalesce(number, F.lit("")), F.lit(" "), F.lit(""))
    u = F.regexp_replace(F.btrim(F.coalesce(unit, F.lit(""))), r"(?i)^(unit|flat|apartment|apt)\s*", "")
    hit = num.rlike("^[A-Za-z0-9]+/[0-9]+[A-Za-z]?$") & (u == "")
    return F.struct(
        F.upper(F.when(hit, F.split_part(num, F.lit("/"), F.lit(2))).otherwise(num)).alias("number"),
        F.nullif(F.upper(F.when(hit, F.split_part(num, F.lit("/"), F.lit(1))).otherwise(u)), F.lit("")).alias("unit"),
    )


def number_of(c: Column) -> Column:
    """Lenient number: null for blank, words, NaN and infinities."""
    v = c.cast("string").try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def address_query(c: Column) -> Column:
    """struct(unit, number, street, suburb) of '[unit/]number street[, suburb]' or 'Unit 2, 15 ...'."""
    word = r"(?i)^(?:unit|flat|apartment|apt)\.?\s*([a-z0-9]+)\s*[,\s]\s*"
    slash, plain = r"(?i)^([a-z0-9]+)\s*/\s*(\d+[a-z]?)(?![a-z0-9])\s*,?\s*", r"(?i)^(\d+[a-z]?)(?![a-z0-9])\s*,?\s*"
    part = lambda s, p, i: F.nullif(F.regexp_extract(s, p, i), F.lit(""))

    def numbered(v: Column) -> Column:
        n2, n1 = part(v["s"], slash, 2), part(v["s"], plain, 1)
        rest = F.when(n2.isNotNull(), F.regexp_replace(v["s"], slash, "")).when(n1.isNotNull(), F.regexp_replace(v["s"], plain, "")).otherwise(v["s"])
        u2 = F.when(n2.isNotNull(), F.regexp_extract(v["s"], slash, 1))
        return F.struct(F.upper(F.coalesce(u2, v["u"])).alias("unit"), F.upper(F.coalesce(n2, n1)).alias("number"), F.split(rest, ",").alias("p"))

    def united(s: Column) -> Column:
        u = part(s, word, 1)
        return F.struct(u.alias("u"), F.when(u.isNotNull(), F.regexp_replace(s, word, "")).otherwise(s).alias("s"))

    def named(v: Column) -> Column:
        return F.struct(v["unit"].alias("unit"), v["number"].alias("number"), F.btrim(F.get(v["p"], F.lit(0))).alias("street"), F.btrim(F.array_join(F.slice(v["p"], 2, 10), " ")).alias("suburb"))

    return let(let(let(F.btrim(F.coalesce(c, F.lit(""))), united), numbered), named)


def search_text(c: Column) -> Column:
    t = F.regexp_replace(fold(c), r"\bcolou?r(s|ed|ing)?\b", "colour")
    t = F.regexp_replace(t, "[’'`]", "")
    return F.btrim(F.regexp_replace(t, r"[^a-z0-9+&.]+", " "))


def search_query(c: Column) -> Column:
    """struct(intent, tokens): what a search asks for and the words to match."""
    w = words(search_text(c))
    intent = F.create_map(*[F.lit(x) for kv in INTENT_WORDS.items() for x in kv])
    first = F.get(w, F.lit(0))
    # only leading stop words may stand before the intent
    lead = F.filter(w, lambda x: ~x.isin(SEARCH_STOP))
    head = F.get(lead, F.lit(0))
    asked = F.try_element_at(intent, head)
    rest = F.when(asked.isNotNull(), F.slice(lead, 2, 1000)).otherwise(lead)
    every = F.filter(w, lambda x: ~x.isin(list(INTENT_WORDS)))
    return F.struct(F.when(first.isNotNull(), asked).alias("intent"), F.when(F.size(rest) > 0, rest).otherwise(every).alias("tokens"))


def one_edit(a: Column, b: Column) -> Column:
    """At most one insertion, deletion, substitution or swap of neighbours apart."""
    swaps = F.transform(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), lambda i: F.concat(F.substr(a, F.lit(1), i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2)))
    return (F.levenshtein(a, b) <= 1) | ((F.length(a) == F.length(b)) & (F.length(a) > 1) & F.array_contains(swaps, b))


def phrase_score(q: Column, phrase: Column) -> Column:
    """0..100: how well the tokens q match a phrase: equal, prefix, words in order, in any order, inside, mistyped."""
    both = F.struct(q.alias("q"), F.filter(words(search_text(phrase)), lambda x: ~x.isin(SEARCH_STOP)).alias("p"))
    return let(both, lambda v: _phrase_score(v["q"], v["p"]))


def _phrase_score(q: Column, p: Column) -> Column:
    ps, qs = F.array_join(p, " "), F.array_join(q, " ")
    zero = F.struct(F.lit(0).alias("k"), F.lit(0).alias("gaps"), F.lit(True).alias("ok"))

    def step(acc: Column, t: Column) -> Column:
        at = F.array_position(F.transform(F.slice(p, acc["k"] + 1, F.greatest(F.size(p), F.lit(1))), lambda x: x.startswith(t)), True).cast("int")
        return let(at, lambda a: F.struct((acc["k"] + a).alias("k"), (acc["gaps"] + F.greatest(a - 1, F.lit(0))).alias("gaps"), (acc["ok"] & (a > 0)).alias("ok")))

    def ordered(o: Column) -> Column:
        loose = F.forall(q, lambda t: F.exists(p, lambda w: w.startswith(t) | ((F.length(t) >= 5) & (one_edit(t, w) | one_edit(t, F.substr(w, F.lit(1), F.length(t)))))))
        return (
            F.when(o["ok"], 80.0 - F.least(F.lit(10.0), o["gaps"] * 2.0))
            .when(F.forall(q, lambda t: F.exists(p, lambda w: w.startswith(t))), 70.0)
            .when(F.forall(q, lambda t: ps.contains(t)), 55.0)
            .when(loose, 45.0)
            .otherwise(0.0)
        )

    return (
        F.when((F.size(q) == 0) | (F.size(p) == 0), 0.0)
        .when(ps == qs, 100.0)
        .when(ps.startswith(qs), 92.0 - F.least(F.lit(10.0), (F.length(ps) - F.length(qs)) * 0.25))
        .otherwise(let(F.aggregate(q, zero, step), ordered))
    )


def height_phrase(c: Column) -> Column:
    """Least height in metres that a phrase asks for ('over 20 m', '30 m or more', '15+'), 2 to 60."""
    t = search_text(c)
    pats = [
        r"(?:taller than|higher than|over|above|at least|min(?:imum)?(?: height)?|height(?: over| above)?) ?(\d{1,2})(?: ?m(?:etres?)?)?\b",
        r"\b(\d{1,2}) ?m(?:etres?)? ?(?:\+|or more|and over|and above|plus|or taller)",
        r"\b(\d{1,2}) ?m? ?\+",
    ]
    n = F.coalesce(*[F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in pats]).cast("int")
    return F.when(n.between(2, 60), n)


def sentence_flags(c: Column, patterns: dict[str, str], negation: str) -> Column:
    """Names of the patterns that some sentence without a negation matches, in the order given."""
    sentences = F.split(F.coalesce(F.lower(c), F.lit("")), r"[.;!?\n]+")

    def told(pattern: str):
        return lambda s: s.rlike(pattern) & ~s.rlike(negation)

    return F.array_compact(F.array(*[F.when(F.exists(sentences, told(p)), name) for name, p in patterns.items()]))


def looks_garbled(c: Column) -> Column:
    """Text decoded with the wrong character set."""
    return F.coalesce(c.rlike("[ÃÂÄÅ][\\u0080-\\u00BF]|â€|\\uFFFD"), F.lit(False))


def record_signature(name: Column, schedule: Column, lon: Column, lat: Column) -> Column:
    """Identity of a record across versions: schedule, name without case, position to 7 decimals."""
    return F.concat_ws("|", F.lower(F.btrim(schedule)), F.lower(F.btrim(name)), F.format_string("%.7f", lon), F.format_string("%.7f", lat))


def significant(c: Column, digits: int) -> Column:
    """Rounded to so many significant figures; zero and null stay."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(c))))
    return F.when(c == 0, 0.0).otherwise(F.round(c * scale) / scale)


def resolve_field(columns: list[str], candidates: list[str]) -> str | None:
    """The column that a loosely written field name means: equal in letters and digits first, then contained."""
    import re

    flat = {re.sub("[^a-z0-9]", "", c.lower()): c for c in reversed(columns)}
    wanted = [re.sub("[^a-z0-9]", "", c.lower()) for c in candidates]
    for w in wanted:
        if w in flat:
            return flat[w]
    for w in wanted:
        for f in sorted(flat):
            if w and w in f:
                return flat[f]
    return None
