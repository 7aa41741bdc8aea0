"""License scan: ordered signature rules over the words of a text.

A rule is a regular expression over normalised words (lower case, one blank between words) with a label. Name
rules are written by hand for each license; those of a family are repeated for its versions, with and without "or
later". Sentence rules hold opening words of license texts. Rules are ordered, the particular before the general.

Three gates keep the expressions off nearly all words: a text is read only if it holds a gate word; in it only
places whose word is the head of a rule are looked at; and there only that head's rules are tried, on the next
`SPAN` words. What stands before a name ("licensed under the terms of the ...") widens the place and tells how
sure the reading is. Every rule that fits gives a place; a place within another one of an earlier rule, or of the
same rule and longer, is dropped ("gnu lesser general public license" is no "general public license"). As no place
is longer than `SPAN` words forward and `BACK` backward, only a bounded number of neighbours are compared.

All of it is DataFrame code in one pass over the texts without a shuffle; the rules are one literal.

Defined results: a null text is the empty text, with no words, places or labels and score 0; texts without a gate
word have their words counted and nothing else; repeated rows and other columns stay as they are; an empty table
gives an empty result.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import or_
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: The same before letters are lowered.
BETWEEN_ANY = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: A text is read if it holds one of these, in lower case.
GATE = (
    "licen", "lizenz", "copyright", "copyleft", "domain", "dominio", "gemeinfrei", "spdx", "creative", "cc-by", "cc by", "cc0", "gpl", "fdl", "warrant", "without fee", "reserv",
    "réserv", "vorbehalten", "redistribut", "permission is", "unencumbered", "wtfpl", "apache",
)
#: Words of a rule at most, and words looked at before a name.
SPAN, BACK = 28, 10
#: Phrases that the contract fixes, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_LIC = "(?:licen[cs]e|lizenz|licencia|licença)"
_LATER = "(?: only)?(?: or| and)?(?: at your option)?(?: any)? (?:later|newer)(?: versions?)?"
# label, heads, name, versions. A version is looked for after the name; families with none have one rule.
FAMILIES = [
    ("agpl", "gnu affero agpl agplv1 agplv3", rf"(?:gnu )?(?:affero general public {_LIC}|agpl)", "1 3"),
    ("lgpl", "gnu lesser library lgpl lgplv2 lgplv3", rf"(?:gnu )?(?:(?:lesser|library)(?: or lesser| or library)? general public {_LIC}|lgpl)", "2 2.1 3"),
    ("gfdl", "gnu free fdl gfdl", rf"(?:gnu )?(?:free documentation {_LIC}|g?fdl)", "1.1 1.2 1.3"),
    ("gpl", "gnu general gpl gplv1 gplv2 gplv3", rf"(?:gnu )?(?:general public {_LIC}|gpl)", "1 2 3"),
    ("apache", "apache asl", rf"(?:apache(?: software)?(?: {_LIC})?|asl)", "1.0 1.1 2.0"),
    ("mpl", "mozilla mpl", rf"(?:mozilla public {_LIC}|mpl)", "1.0 1.1 2.0"),
    ("epl", "eclipse epl", rf"(?:eclipse public {_LIC}|epl)", "1.0 2.0"),
    ("cddl", "common cddl", rf"(?:common development and distribution {_LIC}|cddl)", "1.0 1.1"),
    ("cpl", "common cpl", rf"(?:common public {_LIC}|cpl)", "1.0"),
    ("osl", "open osl", rf"(?:open software {_LIC}|osl)", "1.0 1.1 2.0 2.1 3.0"),
    ("afl", "academic afl", rf"(?:academic free {_LIC}|afl)", "1.1 1.2 2.0 2.1 3.0"),
    ("artistic", "artistic clarified", rf"(?:clarified )?artistic {_LIC}", "1.0 2.0"),
    ("bsl", "boost bsl", rf"(?:boost software {_LIC}|bsl)", "1.0"),
    ("eupl", "european eupl", rf"(?:european union public {_LIC}|eupl)", "1.0 1.1 1.2"),
    ("cecill", "cecill", rf"cecill(?: [bc])?(?: {_LIC})?", "1.0 1.1 2.0 2.1"),
    ("ofl", "sil ofl open", rf"(?:(?:sil )?open font {_LIC}|ofl)", "1.0 1.1"),
    ("lppl", "latex lppl", rf"(?:latex project public {_LIC}|lppl)", "1.0 1.1 1.2 1.3"),
    ("psf", "python psf", rf"(?:python(?: software foundation)? {_LIC}|psf {_LIC})", "2 3"),
    ("php", "php", rf"php {_LIC}", "2.02 3.0 3.01"),
    ("zpl", "zope zpl", rf"(?:zope public {_LIC}|zpl)", "1.1 2.0 2.1"),
    ("sspl", "server sspl", rf"(?:server side public {_LIC}|sspl)", "1"),
    ("busl", "business busl", rf"(?:business source {_LIC}|busl)", "1.1"),
    ("elastic", "elastic", rf"elastic {_LIC}", "2.0"),
    ("odbl", "open odbl", rf"(?:open (?:data commons open )?database {_LIC}|odbl)", "1.0"),
    ("odc-by", "open odc", rf"(?:open data commons attribution {_LIC}|odc by)", "1.0"),
    ("cern-ohl", "cern", rf"cern (?:open hardware {_LIC}|ohl)(?: [spw])?", "1.1 1.2 2"),
    ("ogl", "open uk", rf"(?:uk )?open government {_LIC}", "1.0 2.0 3.0"),
    ("nasa", "nasa", "nasa open source agreement", "1.3"),
    ("apsl", "apple apsl", rf"(?:apple public source {_LIC}|apsl)", "1.0 1.1 1.2 2.0"),
    ("cc-by-nc-sa", "cc creative attribution by", "(?:(?:cc|creative commons) )?(?:by nc sa|attribution non ?commercial share ?alike)", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc-nd", "cc creative attribution by", "(?:(?:cc|creative commons) )?(?:by nc nd|attribution non ?commercial no ?deriv(?:ative)?s?)", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc", "cc creative attribution by", "(?:cc by nc|(?:creative commons )?attribution non ?commercial)", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-sa", "cc creative attribution by", "(?:cc by sa|(?:creative commons )?attribution share ?alike)", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nd", "cc creative attribution by", "(?:cc by nd|(?:creative commons )?attribution no ?deriv(?:ative)?s?)", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by", "cc creative", "(?:cc by|creative commons attribution)", "1.0 2.0 2.5 3.0 4.0"),
]
# label, heads, name: licenses without versions, the particular first.
NAMES = [
    ("mit-0", "mit", f"mit (?:0|no attribution)(?: {_LIC})?"), ("mit", "mit expat x11", f"(?:mit(?: x11| expat| style)?|expat|x11) {_LIC}"),
    ("bsd-4-clause", "4 four original bsd", f"(?:(?:4|four) clause bsd|original bsd|bsd 4 clause)(?: {_LIC})?"),
    ("bsd-3-clause", "3 three new modified revised bsd", f"(?:(?:3|three) clause bsd|(?:new|modified|revised) bsd|bsd 3 clause)(?: {_LIC})?"),
    ("bsd-2-clause", "2 two simplified freebsd bsd", f"(?:(?:2|two) clause bsd|simplified bsd|freebsd|bsd 2 clause) ?{_LIC}?"),
    ("0bsd", "0bsd zero bsd", f"(?:0bsd|zero clause bsd|bsd zero clause)(?: {_LIC})?"), ("bsd", "bsd", f"bsd(?: style)? {_LIC}"),
    ("isc", "isc", f"isc {_LIC}"), ("zlib", "zlib", f"zlib(?: libpng)? {_LIC}"), ("libpng", "libpng", f"libpng {_LIC}"),
    ("unlicense", "unlicense the", f"(?:the )?unlicense"), ("wtfpl", "wtfpl do", f"(?:wtfpl|do what the fuck you want to public {_LIC})"),
    ("cc0", "cc0 creative cc", "(?:cc0|cc zero|creative commons (?:cc0|zero))(?: 1 0)?(?: universal)?"), ("beerware", "beerware beer", f"beer ?ware {_LIC}"),
    ("ncsa", "university ncsa", f"(?:university of illinois )?ncsa(?: open source)? {_LIC}"), ("postgresql", "postgresql", f"postgresql {_LIC}"),
    ("curl", "curl", f"curl {_LIC}"), ("openssl", "openssl", f"openssl {_LIC}"), ("ssleay", "ssleay", f"ssleay {_LIC}"), ("vim", "vim", f"vim {_LIC}"),
    ("ruby", "ruby", f"ruby {_LIC}"), ("tcl", "tcl", f"tcl(?: tk)? {_LIC}"), ("w3c", "w3c", f"w3c (?:software )?(?:notice and )?{_LIC}"),
    ("ms-pl", "microsoft ms", f"(?:microsoft public {_LIC}|ms pl)"), ("ms-rl", "microsoft ms", f"(?:microsoft reciprocal {_LIC}|ms rl)"),
    ("ftl", "freetype", f"freetype(?: project)? {_LIC}"), ("ijg", "independent ijg", f"(?:independent jpeg group|ijg) {_LIC}"), ("info-zip", "info", f"info zip {_LIC}"),
    ("icu", "icu", f"icu {_LIC}"), ("unicode", "unicode", f"unicode(?: data files and software)? {_LIC}"), ("hpnd", "historical", "historical permission notice and disclaimer"),
    ("sleepycat", "sleepycat", f"sleepycat {_LIC}"), ("qpl", "q qpl", f"(?:q public {_LIC}|qpl)"), ("npl", "netscape npl", f"(?:netscape public {_LIC}|npl)"),
    ("spl", "sun", f"sun public {_LIC}"), ("ipl", "ibm", f"ibm public {_LIC}"), ("ecl", "educational", f"educational community {_LIC}"), ("upl", "universal", f"universal permissive {_LIC}"),
    ("mulan", "mulan", f"mulan (?:permissive|pspl|psl) ?{_LIC}?"), ("blueoak", "blue", f"blue oak model {_LIC}"), ("json", "json", f"json {_LIC}"),
    ("commons-clause", "commons", "commons clause"), ("polyform", "polyform", f"polyform (?:noncommercial|small business|shield|strict|perimeter) {_LIC}"),
    ("openrail", "openrail creativeml", f"(?:creativeml )?open ?rail(?: [ms]+)?(?: {_LIC})?"), ("llama", "llama", f"llama(?: [23])? community {_LIC}"),
]
# label, words that open a license's own text.
SENTENCES = [
    ("agpl", f"gnu affero general public {_LIC} version 3 19 november 2007"), ("lgpl", f"gnu lesser general public {_LIC} version"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation"),
    ("ncsa", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement"),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "neither the name of (?:the )?(?:[^ ]+ ){1,8}nor the names of its contributors may be used to endorse"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("unlicense", "this is free and unencumbered software released into the public domain"), ("wtfpl", "you just do what the fuck you want to"),
    ("apache-2.0", "terms and conditions for use reproduction and distribution 1 definitions"), ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public"), ("mpl-1.1", "the contents of this file are subject to the mozilla public"),
    ("ofl-1.1", "this font software is licensed under the sil open font"), ("beerware", "as long as you retain this notice you can do whatever you want with this stuff"),
    ("epl", "the program and accompanying materials are made available under the terms of the eclipse public"),
    ("json", "the software shall be used for good not evil"), ("curl", "copyright and permission notice copyright c [^ ]+ [^ ]+ daniel stenberg"),
]
# label, words that tell rights without naming a license.
NOTICES = [
    ("public-domain", "(?:(?:in|into|to) the )?public domain"), ("public-domain", "domaine public"), ("public-domain", "dominio p[uú]blico"), ("public-domain", "gemeinfrei"),
    ("all-rights-reserved", "all rights reserved"), ("all-rights-reserved", "tous droits réservés"), ("all-rights-reserved", "alle rechte vorbehalten"), ("all-rights-reserved", "todos los derechos reservados"),
    ("copyright", "copyright (?:c )?(?:19|20)[0-9]{2}"), ("copyleft", "copyleft"), ("no-warranty", "without warranty of any kind"), ("no-warranty", "provided as is without warranty"),
    ("non-commercial", "for non ?commercial use only"), ("non-commercial", "for (?:personal|educational|academic) use only"), ("proprietary", f"proprietary (?:{_LIC}|and confidential)"),
]
# What may stand before a name, and how sure it makes the reading (hundredths).
FORMS = [
    (100, "spdx license identifier "),
    (95, "(?:licensed|released|distributed|available|published|provided|covered|redistributed|made available|offered) (?:under|by) (?:the )?(?:terms(?: and conditions)? of (?:either )?)?(?:the |an? )?"),
    (90, "(?:under|to) (?:the )?(?:terms(?: and conditions)? of (?:the )?)?|(?:sous|unter|bajo|sob) (?:les termes de )?(?:la |der |a )?(?:licen[cs]e |lizenz |licencia |licença )?"),
    (85, "(?:license|licence|lizenz|licencia|licença) (?:is )?(?:the )?"),
]
BARE, NOTICE = 60, 40


def _version(v: str) -> str:
    major, _, minor = v.partition(".")
    tail = f" {minor}" if minor and minor != "0" else "(?: 0)?"
    return f"(?: version| versions| v)? ?v?{major}{tail}"


def rules() -> list[tuple[int, str, str, str, int]]:
    """All rules in order: number, head word, pattern, label, least sureness in hundredths."""
    made: list[tuple[str, str, str, int]] = [(s.split(" ")[0], s, label, 100) for label, s in SENTENCES]
    for label, heads, name, versions in FAMILIES:
        for v in sorted(versions.split(), key=lambda v: v.endswith(".0") or "." not in v):  # 1.1 before 1.0, which reads "1" too
            named = f"{label}-{v}{'.0' if '.' not in v and label.endswith('gpl') and v != '2.1' else ''}"
            glued = rf"(?:{name}{_version(v)}|{label}v{v.replace('.', ' ')})" if label.endswith("gpl") else f"{name}{_version(v)}"
            if label.endswith("gpl"):
                made += [(h, glued + _LATER, f"{named}-or-later", BARE) for h in heads.split()]
            made += [(h, glued, named, BARE) for h in heads.split()]
        # a bare short name may be another word, so it has to be called a license or to be spelled out
        made += [(h, name if _LIC in name and h != label or label.startswith("cc-") or label == "nasa" else f"{name} {_LIC}", label, BARE) for h in heads.split()]
    made += [(h, name, label, BARE) for label, heads, name in NAMES for h in heads.split()]
    made += [(h, name, label, NOTICE) for label, name in NOTICES for h in _heads(name)]
    return [(i, h, p, label, sure) for i, (h, p, label, sure) in enumerate(made)]


def _heads(name: str) -> list[str]:
    return ["in", "into", "to", "public"] if name.startswith("(?:(?:in") else [name.split(" ")[0]]


def lowered(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def _by_head(listed: list[tuple[int, str, str, str, int]]) -> tuple[Column, Column]:
    """The rules as literals: map of head to rules, array of heads."""
    by_head: dict[str, list] = {}
    for number, head, pattern, label, sure in listed:
        by_head.setdefault(head, []).append({"rule": number, "pattern": f"^((?:{pattern}) )", "label": label, "sure": sure})
    made = lambda x, kind: F.from_json(F.lit(json.dumps(x, ensure_ascii=False)), kind)
    return made(by_head, "map<string,array<struct<rule:int,pattern:string,label:string,sure:int>>>"), made(sorted(by_head), "array<string>")


def _places(w: Column, heads: Column, table_: Column) -> Column:
    """Array of the places of a text, in order of their heads: start, stop (past the last word), rule, label, sure.
    heads: those that the text holds."""
    at = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("word"), i.alias("at"))), lambda x: F.array_contains(heads, x["word"]))
    blanks = lambda s: F.size(F.split(s, " ")) - 1

    def near(x: Column) -> Column:
        after = F.concat(F.array_join(F.slice(w, x["at"] + 1, SPAN), " "), F.lit(" "))
        before = F.concat(F.lit(" "), F.array_join(F.slice(w, F.greatest(x["at"] - BACK, F.lit(0)) + 1, F.least(x["at"], F.lit(BACK))), " "), F.lit(" "))
        return F.struct(x["at"].alias("at"), x["word"].alias("word"), after.alias("after"), before.alias("before"))

    def fit(x: Column) -> Column:
        tried = F.transform(F.element_at(table_, x["word"]), lambda r: F.struct(r["rule"].alias("rule"), r["label"].alias("label"), r["sure"].alias("sure"), F.call_function("regexp_extract", x["after"], r["pattern"], F.lit(1)).alias("got")))
        return F.filter(tried, lambda r: r["got"] != "")

    def lead(x: Column) -> Column:
        """Words before the name and the sureness that they give, of the first form that fits."""
        forms = [F.when(F.regexp_extract(x["before"], f" ((?:{p}))$", 1) != "", F.struct(blanks(F.regexp_extract(x["before"], f" ((?:{p}))$", 1)).alias("words"), F.lit(s).alias("sure"))) for s, p in FORMS]
        return F.coalesce(*forms, F.struct(F.lit(0).alias("words"), F.lit(0).alias("sure")))

    def placed(x: Column) -> Column:
        named = F.struct(x["near"]["at"].alias("at"), lead(x["near"]).alias("lead"), x["fit"].alias("fit"))
        return F.transform(F.array(named), lambda y: F.transform(y["fit"], lambda r: F.struct(
            (y["at"] - F.when(r["sure"] == BARE, y["lead"]["words"]).otherwise(0)).alias("start"), (y["at"] + blanks(r["got"])).alias("stop"), r["rule"].alias("rule"), r["label"].alias("label"),
            F.when(r["sure"] == BARE, F.greatest(r["sure"], y["lead"]["sure"])).otherwise(r["sure"]).alias("sure"))))[0]

    fitted = F.filter(F.transform(F.transform(at, near), lambda n: F.struct(n.alias("near"), fit(n).alias("fit"))), lambda x: F.size(x["fit"]) > 0)
    return F.transform(fitted, placed)


def _kept(places: Column) -> Column:
    """Places (one array for each head's place) that no place of an earlier rule, nor a longer one of the same
    rule, contains. A container's head stands within SPAN + BACK words, thus within as many heads."""
    far = SPAN + BACK

    def outdone(p: Column, i: Column) -> Column:
        around = F.flatten(F.slice(places, F.greatest(i - far, F.lit(0)) + 1, F.lit(2 * far + 1)))
        longer = lambda q: q["stop"] - q["start"] > p["stop"] - p["start"]
        return F.exists(around, lambda q: (q["start"] <= p["start"]) & (q["stop"] >= p["stop"]) & ((q["rule"] < p["rule"]) | ((q["rule"] == p["rule"]) & longer(q))))

    return F.flatten(F.transform(places, lambda ps, i: F.filter(ps, lambda p: ~outdone(p, i))))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, base (array of word number and label of each fixed phrase) and places (array of start,
    stop, rule, label, sure; start and stop in words)."""
    low = F.lower(F.col(text))
    gated = F.when(reduce(or_, [F.contains(low, F.lit(g)) for g in GATE]), F.col(text))
    count = lambda xs: F.size(F.array_remove(xs, ""))
    one = docs.withColumn("n_words", F.coalesce(F.when(F.col(text).isNotNull(), count(F.split(text, BETWEEN_ANY))), F.lit(0)).cast("bigint"))
    w, heads, (table_, all_heads) = F.col("_words"), F.col("_heads"), _by_head(rules())
    # each step is exploded from an array of one, which keeps it from being computed again for each use
    one = one.withColumn("_words", F.explode(F.array(F.coalesce(F.array_remove(F.split(lowered(gated), BETWEEN), ""), F.array().cast("array<string>")))))
    one = one.withColumn("_heads", F.explode(F.array(F.array_intersect(w, all_heads))))

    def phrase(x: Column, i: Column) -> Column:
        fits = [F.when(F.array_join(F.slice(w, i + 1, F.lit(len(p.split()))), " ") == p, F.lit(label)) for p, label in BASE.items()]
        return F.struct(i.cast("bigint").alias("at"), F.when(x.isin([p.split()[0] for p in BASE]), F.coalesce(*fits)).alias("label"))

    base = F.filter(F.transform(w, phrase), lambda x: x["label"].isNotNull())
    found = one.withColumn("base", base).withColumn("_places", F.explode(F.array(_places(w, heads, table_))))
    return found.withColumn("places", _kept(F.col("_places"))).drop("_words", "_heads", "_places")


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses that all documents name or carry."""
    found = scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    at, of_base, own = F.col("base.at"), F.col("base.label"), F.col("places.label")
    joined = lambda xs: F.array_join(F.array_sort(F.array_distinct(xs)), ",")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        joined(of_base).alias("base_labels"), joined(F.concat(of_base, own)).alias("labels"),
        (F.coalesce(F.array_max("places.sure"), F.lit(0)) / 100.0).alias("score"),
    )


def _sql() -> str:
    """The same scan as plain SQL over the same rules: one row for each place, pattern and form."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    listed = ", ".join(f"({n}, {text(h)}, {text(f'^((?:{p}) )')}, {text(label)}, {sure})" for n, h, p, label, sure in rules())
    leads = " ".join(f"WHEN regexp_matches(before, {text(f' (?:{p})$')}) THEN {{{{'words': len(string_split(regexp_extract(before, {text(f' ((?:{p}))$')}, 1), ' ')) - 1, 'sure': {s}}}}}".replace("{{", "{").replace("}}", "}") for s, p in FORMS)
    gate = " OR ".join(f"contains(lower(text), {text(g)})" for g in GATE)
    phrases = " ".join(f"WHEN array_to_string(ws[i:i + {len(p.split()) - 1}], ' ') = {text(p)} THEN {text(label)}" for p, label in BASE.items())
    return rf"""
WITH r(rule, head, pattern, label, sure) AS (VALUES {listed}),
t AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT id, doc_id, {gate} AS gated, regexp_extract_all(translate(text, '{ascii_uppercase}', '{ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM t),
i AS (SELECT id, gated, ws, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE gated),
b AS (SELECT id, count(*) AS n, min(i) - 1 AS first, max(i) - 1 AS last, list(label) AS labels FROM (SELECT id, i, CASE {phrases} END AS label FROM i) WHERE label IS NOT NULL GROUP BY 1),
p AS (SELECT id, i, ws[i] AS word, array_to_string(ws[i:i + {SPAN - 1}], ' ') || ' ' AS after, ' ' || array_to_string(ws[greatest(i - {BACK}, 1):i - 1], ' ') || ' ' AS before FROM i WHERE ws[i] IN (SELECT head FROM r)),
l AS (SELECT *, CASE {leads} ELSE {{'words': 0, 'sure': 0}} END AS lead FROM p),
f AS (SELECT id, i, rule, label, sure, lead, regexp_extract(after, pattern, 1) AS got FROM l JOIN r ON head = word),
d AS (SELECT id, rule, label, i - CASE WHEN sure = {BARE} THEN lead.words ELSE 0 END AS start, i + len(string_split(got, ' ')) - 1 AS stop, CASE WHEN sure = {BARE} THEN greatest(sure, lead.sure) ELSE sure END AS sure FROM f WHERE got <> ''),
k AS (SELECT id, list(label) AS labels, max(sure) AS sure FROM d WHERE NOT EXISTS (SELECT 1 FROM d e WHERE e.id = d.id AND e.start <= d.start AND e.stop >= d.stop
  AND (e.rule < d.rule OR (e.rule = d.rule AND e.stop - e.start > d.stop - d.start))) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first::BIGINT AS first_word, last::BIGINT AS last_word,
  array_to_string(list_sort(list_distinct(coalesce(b.labels, []))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(k.labels, [])))), ',') AS labels, coalesce(sure, 0) / 100.0::DOUBLE AS score
FROM w LEFT JOIN b USING (id) LEFT JOIN k USING (id)
"""


SQL = {"op13_license_scan": _sql()}
