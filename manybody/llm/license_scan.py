"""License scan with ordered signature rules, in DataFrame expressions only.

A text becomes its lower-cased words between single spaces. Rules are regular
expressions on that form, each with a keyword that its matches always contain:
a row is looked at only if one of a few roots occurs in it, and a rule only if
its keyword does. Every place of a match is an interval of words. A detection is
dropped if it lies within one of a better rule (lower priority number) or within
a longer one of an equal rule; base phrases always stay. All of it happens
within a row, so nothing is shuffled.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table
from .license_signatures import SIGNATURES

#: Phrases that every scan reports, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: A row is scanned if it holds one of these; every rule's matches do.
ROOTS = (
    "licen", "spdx", " cc ", "cc by", " cc0", "creative commons", "creativecommons", "public domain", "gpl", "copyright", "copyleft",
    "eupl", "lppl", "eclipse org", "mozilla org", "permission", "without restriction", "provided as is", "as is basis", "disclaims all",
    "redistribution", "endorse or promote", "all advertising", "advertising", "regents of", "includes software", "includes cryptographic",
    "same terms as", "kernel services", "embed this font", "your agreement", "altered source versions", "jpeg group", "mulan psl",
    "you just do what", "good not evil", "datenlizenz", "commons clause", "confidential", "strictly prohibited", "may not be reproduced",
    "commercial use", "permitted", "gcc runtime library", "neighboring rights", "mit no attribution", "llvm exceptions", "terms of use", "open font",
)

# label: (words one of which every form of the name holds, the name's forms as a regular expression on words)
NAMES = {
    "mit": ("mit|expat", "(?:mit|expat|mit x11)"),
    "apache-2": ("apache", "apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)?"),
    "apache-1.1": ("apache", "apache(?: software)?(?: license)?(?: version| v)? ?1 1"),
    "bsd-2-clause": ("bsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)"),
    "bsd-3-clause": ("bsd", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)"),
    "bsd-4-clause": ("bsd", "(?:bsd 4 clause|4 clause bsd|original bsd)"),
    "0bsd": ("bsd", "(?:0bsd|zero clause bsd|bsd zero clause)"),
    "isc": (" isc", "isc"),
    "gpl-1": ("gpl|general public", "(?:gnu general public license|gnu gpl|gpl)(?: version| v)? ?1(?: 0)?"),
    "gpl-2": ("gpl|general public", "(?:gnu general public license|gnu gpl|gpl)(?: version| v)? ?2(?: 0)?"),
    "gpl-3": ("gpl|general public", "(?:gnu general public license|gnu gpl|gpl)(?: version| v)? ?3(?: 0)?"),
    "lgpl-2": ("lgpl|general public", "(?:gnu (?:lesser|library) general public license|gnu lgpl|lgpl)(?: version| v)? ?2(?: 0)?"),
    "lgpl-2.1": ("lgpl|general public", "(?:gnu lesser general public license|gnu lgpl|lgpl)(?: version| v)? ?2 1"),
    "lgpl-3": ("lgpl|general public", "(?:gnu lesser general public license|gnu lgpl|lgpl)(?: version| v)? ?3(?: 0)?"),
    "agpl-3": ("agpl|affero", "(?:gnu affero general public license|gnu agpl|agpl)(?: version| v)? ?3(?: 0)?"),
    "mpl-1.1": ("mozilla|mpl", "(?:mozilla public license|mpl)(?: version| v)? ?1 1"),
    "mpl-2": ("mozilla|mpl", "(?:mozilla public license|mpl)(?: version| v)? ?2(?: 0)?"),
    "epl-1": ("eclipse|epl", "(?:eclipse public license|epl)(?: version| v)? ?1(?: 0)?"),
    "epl-2": ("eclipse|epl", "(?:eclipse public license|epl)(?: version| v)? ?2(?: 0)?"),
    "cddl-1": ("cddl|common development", "(?:common development and distribution license|cddl)(?: version| v)? ?1(?: 0)?"),
    "cpl-1": ("cpl|common public", "(?:common public license|cpl)(?: version| v)? ?1(?: 0)?"),
    "eupl-1.2": ("eupl|european union", "(?:european union public licen[cs]e|eupl)(?: version| v)? ?1 2"),
    "artistic-1": ("artistic", "artistic(?: license)?(?: version| v)? ?1(?: 0)?"),
    "artistic-2": ("artistic", "artistic(?: license)?(?: version| v)? ?2(?: 0)?"),
    "boost-1": ("boost|bsl", "(?:boost software license|bsl)(?: version| v)? ?1(?: 0)?"),
    "zlib": ("zlib", "zlib(?: libpng)?"),
    "unlicense": ("unlicense", "unlicense"),
    "wtfpl": ("wtf|do what the fuck", "(?:wtfpl|do what the fuck you want to public license)"),
    "cc0-1": ("cc0|cc zero|creative commons", "(?:cc0|cc zero|creative commons zero)(?: 1 0)?"),
    "cc-by-3": ("cc by|creative commons", "(?:cc by|creative commons attribution) 3 0"),
    "cc-by-4": ("cc by|creative commons", "(?:cc by|creative commons attribution) 4 0"),
    "cc-by-sa-3": ("cc by|creative commons", "(?:cc by sa|creative commons attribution share ?alike) 3 0"),
    "cc-by-sa-4": ("cc by|creative commons", "(?:cc by sa|creative commons attribution share ?alike) 4 0"),
    "cc-by-nd-4": ("cc by|creative commons", "(?:cc by nd|creative commons attribution no ?derivatives) 4 0"),
    "cc-by-nc-4": ("cc by|creative commons", "(?:cc by nc|creative commons attribution non ?commercial) 4 0"),
    "cc-by-nc-sa-4": ("cc by|creative commons", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike) 4 0"),
    "cc-by-nc-nd-4": ("cc by|creative commons", "(?:cc by nc nd|creative commons attribution non ?commercial no ?derivatives) 4 0"),
    "odbl-1": ("open da|odbl|odc", "(?:open (?:data commons )?database license|odbl)(?: v?1 0)?"),
    "odc-by-1": ("open da|odbl|odc", "(?:open data commons attribution license|odc by)(?: v?1 0)?"),
    "pddl-1": ("pddl|public domain", "(?:public domain dedication and license|pddl)(?: v?1 0)?"),
    "ofl-1.1": ("open font|ofl", "(?:sil open font license|open font license|ofl)(?: version)? 1 1"),
    "psf-2": ("python|psf", "(?:python software foundation license|psf)(?: version)? ?2(?: 0)?"),
    "postgresql": ("postgresql", "postgresql"),
    "openssl": ("openssl", "openssl"),
    "php-3": ("php", "php(?: license)?(?: version| v)? 3(?: 0| 01)?"),
    "ruby": ("ruby", "ruby"),
    "ms-pl": ("microsoft|ms ", "(?:microsoft public license|ms pl)"),
    "ms-rl": ("microsoft|ms ", "(?:microsoft reciprocal license|ms rl)"),
    "ncsa": ("ncsa", "(?:university of illinois ncsa open source license|ncsa)"),
    "upl-1": ("upl|universal", "(?:universal permissive license|upl)(?: v?1 0)?"),
    "llama-2": ("llama", "llama 2 community"),
    "llama-3": ("llama", "llama 3 community"),
    "gemma": ("gemma", "gemma terms of use"),
    "openrail-m": ("rail", "(?:openrail m|open rail m|bigscience rail|creativeml open ?rail m)"),
}

# (priority, what precedes the name, what follows it): the sentence that grants comes before the bare name
FORMS = (
    (1, "spdx license identifier ", ""),
    (2, "(?:is |are |been )?(?:licen[cs]ed|released|distributed|available|made available|provided|published) under (?:the (?:terms (?:and conditions )?of )?)?(?:the |a |an )?", " licen[cs]e"),
    (3, "under (?:the )?(?:terms (?:and conditions )?of )?(?:the |a |an )?", " licen[cs]e"),
    (4, "licen[cs]e ", ""),
    (5, "", " licen[cs]e"),
)

# further signatures with a name of their own: label, priority, keyword, expression
OTHERS = (
    ("mit", 1, "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy(?: of this software)?[^\\n]{0,400}?licen[cs]e"),
    ("bsd", 2, "redistributions", "redistributions of source code must retain the above copyright notice"),
    ("public-domain", 3, "public domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", 6, "public domain", "public domain"),
    ("proprietary", 4, "all rights reserved", "copyright(?: c)?(?: [0-9]{4})?(?: [^ ]+){0,6} all rights reserved"),
    ("copyleft", 6, "copyleft", "copyleft"),
    ("gpl", 6, "gpl", "(?:gnu )?gpl"),
    ("cc-by", 4, " cc by", "cc by [0-9] 0"),
    ("cc-by-sa", 4, " cc by sa", "cc by sa(?: [0-9] 0)?"),
    ("cc-by-nc", 3, " cc by nc", "(?:licen[cs]ed under )?cc by nc(?: [0-9] 0)?"),
    ("unspecified", 7, "licen", "(?:licen[cs]ed under|see licen[cs]e(?: file)?|subject to the licen[cs]e)"),
)


def rules() -> list[dict]:
    """All signatures: label, priority, keyword, expression, and whether a base phrase."""
    out = [{"label": label, "p": 0, "kw": [phrase], "re": phrase, "base": True} for phrase, label in BASE.items()]
    for label, (word, name) in NAMES.items():
        for p, before, after in FORMS:
            if p == 5 and "licen" in name and not after:
                continue
            out.append({"label": label, "p": p, "kw": word.split("|"), "re": f"{before}{name}{after}", "base": False})
    out += [{"label": label, "p": p, "kw": kw.split("|"), "re": x, "base": False} for label, p, kw, x in (*OTHERS, *SIGNATURES)]
    return [r | {"re": f"(?<= )(?:{r['re']})(?= )", "id": i} for i, r in enumerate(out)]


SCHEMA = "array<struct<label:string,p:int,kw:array<string>,re:string,base:boolean,id:int>>"


def words_form(text: Column) -> Column:
    """Space, the words with one space between them, space; null counts as empty."""
    lowered = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    return F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(lowered, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " "), "^ | $", ""), F.lit(" "))


#: Matches are marked before their first and after their last word, and the words' numbers are read off: linear in the text.
_PLACES = """
flatten(transform(filter(ls_rules, r -> exists(r.kw, k -> contains(ls_words, k)) and rlike(ls_words, r.re)), r -> element_at(transform(
  array(split(regexp_replace(ls_words, r.re, '\x01$0\x02'), ' ')),
  w -> zip_with(
    filter(transform(w, (x, i) -> case when startswith(x, '\x01') then i - 1 end), i -> i is not null),
    filter(transform(w, (x, i) -> case when endswith(x, '\x02') then i end), i -> i is not null),
    (s, e) -> named_struct('s', s, 'e', e, 'p', r.p, 'label', r.label, 'base', r.base, 'id', r.id))), 1)))
"""

_FOUND = "array<struct<s:int,e:int,p:int,label:string,base:boolean,id:int>>"
#: In order of (start, -end, priority): best[p] is the largest end of priority p so far; one within such an end goes.
#: What stays is gathered by 256, as appending to one array copies it each time.
_KEPT = f"""
element_at(transform(
  array(array_sort(ls_found, (x, y) -> case when x.s <> y.s then x.s - y.s when x.e <> y.e then y.e - x.e when x.p <> y.p then x.p - y.p else x.id - y.id end)),
  f -> aggregate(
    sequence(0, (size(f) - 1) div 256),
    named_struct('best', array_repeat(-1, 8), 'out', cast(array() as {_FOUND}), 'outs', cast(array() as array<{_FOUND}>)),
    (a, i) -> aggregate(
      slice(f, int(i * 256 + 1), 256),
      named_struct('best', a.best, 'out', cast(array() as {_FOUND}), 'outs', concat(a.outs, array(a.out))),
      (c, x) -> named_struct(
        'best', transform(c.best, (v, k) -> case when k = x.p then greatest(v, x.e) else v end),
        'out', case when x.base or not exists(slice(c.best, 1, x.p + 1), v -> v >= x.e) then concat(c.out, array(x)) else c.out end,
        'outs', c.outs)),
    a -> flatten(concat(a.outs, array(a.out))))), 1)
"""


def scan(docs: DataFrame) -> DataFrame:
    """docs with n_words and licenses added: the kept detections (s, e: words from s up to e; p: priority; label; base; id: rule).

    docs needs text; null or empty texts have no words and no detections. Repeated rows
    stay; columns named n_words and licenses are replaced, those that begin with ls_ are
    the scan's own. A rule of equal priority that starts and ends alike goes after the one
    listed first.
    """
    rule = F.from_json(F.lit(json.dumps(rules())), SCHEMA)
    gate = None
    for root in ROOTS:
        gate = F.contains("ls_words", F.lit(root)) if gate is None else gate | F.contains("ls_words", F.lit(root))
    out = docs.withColumn("ls_words", words_form(F.col("text"))).withColumn("n_words", F.when(F.col("ls_words") == "  ", 0).otherwise(F.length("ls_words") - F.length(F.replace("ls_words", F.lit(" "), F.lit(""))) - 1).cast("long"))
    out = out.withColumn("ls_rules", F.when(gate, rule)).withColumn("ls_found", F.expr(f"case when ls_rules is not null then {_PLACES} else array() end"))
    return out.withColumn("licenses", F.expr(f"case when size(ls_found) > 0 then {_KEPT} else ls_found end")).drop("ls_words", "ls_rules", "ls_found")


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every document's license findings: places of the base phrases, base labels and all labels."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("b", F.expr("filter(licenses, x -> x.base)")).select(
        "doc_id",
        "n_words",
        F.size("b").cast("long").alias("n_base"),
        F.expr("cast(array_min(transform(b, x -> x.s)) as long)").alias("first_word"),
        F.expr("cast(array_max(transform(b, x -> x.s)) as long)").alias("last_word"),
        F.expr("array_join(array_sort(array_distinct(transform(b, x -> x.label))), ',')").alias("base_labels"),
        F.expr("array_join(array_sort(array_distinct(transform(licenses, x -> x.label))), ',')").alias("labels"),
        F.expr("cast(coalesce(array_max(transform(licenses, x -> 1 - x.p / 8.0D)), 0.0D) as double)").alias("score"),
    )
