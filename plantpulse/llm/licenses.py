"""License scans by sentence rules; DataFrame functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# a sentence ends at a mark that white space follows, or at a line end; in wrapped text, where single line
# ends are spaces, at an empty line, for which the gap sign stands
GAP = "\x01"
CUT = r"(?<=[.!?;:])\s+|\n+"
CUT_WRAPPED = rf"(?<=[.!?;:])\s+{GAP}*|{GAP}+"
# lines that hold nothing but white space and comment marks are empty
EMPTY_LINES = r"\n(?:[\x20\t\x0B\f#*/;%!'<>|-]*\n)+"
# comment marks that would end a sentence
LEADING_MARKS = rf"(^|[\n{GAP}])[\x20\t\x0B\f]*[;!]+"
NOT_PLAIN = "[^a-z0-9]+"

# a company's abbreviation ends no sentence where a small letter follows
ABBREVIATION = r"(Inc|Ltd|Corp|Co)\.([\x20\t\n\x0B\f#*/;%!'<>|-]+[a-z])"

# Licence names as notices write them, with their SPDX identifiers.
NAMES = {
    "mit license": "MIT", "mit licence": "MIT", "mit no attribution license": "MIT-0",
    "apache license version 2 0": "Apache-2.0", "apache license 2 0": "Apache-2.0",
    "apache 2 0 license": "Apache-2.0", "apache license": "Apache-2.0",
    "bsd 2 clause license": "BSD-2-Clause", "2 clause bsd license": "BSD-2-Clause",
    "bsd 3 clause license": "BSD-3-Clause", "3 clause bsd license": "BSD-3-Clause",
    "bsd 4 clause license": "BSD-4-Clause", "bsd zero clause license": "0BSD",
    "isc license": "ISC", "unlicense": "Unlicense", "zlib license": "Zlib", "postgresql license": "PostgreSQL",
    "mozilla public license version 2 0": "MPL-2.0", "mozilla public license 2 0": "MPL-2.0",
    "mozilla public license v 2 0": "MPL-2.0", "mozilla public license version 1 1": "MPL-1.1",
    "eclipse public license v 2 0": "EPL-2.0", "eclipse public license v2 0": "EPL-2.0",
    "eclipse public license version 2 0": "EPL-2.0", "eclipse public license v 1 0": "EPL-1.0",
    "eclipse public license v1 0": "EPL-1.0", "eclipse public license version 1 0": "EPL-1.0",
    "boost software license version 1 0": "BSL-1.0", "sil open font license version 1 1": "OFL-1.1",
    "artistic license 2 0": "Artistic-2.0", "european union public licence v 1 2": "EUPL-1.2",
    "cc0 1 0": "CC0-1.0", "creative commons zero": "CC0-1.0",
}
# Creative Commons names follow a pattern: parts and version
CC_WORDS = {"by": "attribution", "nc": "noncommercial", "nd": "noderivatives", "sa": "sharealike"}
CC_REACH = {"2 0": "generic", "2 5": "generic", "3 0": "unported", "4 0": "international"}
CC_TITLES = {}
for _parts in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"):
    for _version, _reach in CC_REACH.items():
        _spdx = f"CC-{_parts.upper().replace(' ', '-')}-{_version.replace(' ', '.')}"
        _words = " ".join(CC_WORDS[x] for x in _parts.split())
        NAMES[f"cc {_parts} {_version}"] = _spdx
        NAMES[f"cc {_parts} {_version} license"] = _spdx
        NAMES[f"creative commons {_parts} {_version} license"] = _spdx
        NAMES[f"creative commons {_words} {_version} license"] = _spdx
        NAMES[f"creative commons {_words} {_version} {_reach} license"] = _spdx
        CC_TITLES[f"{_words} {_version} {_reach}"] = _spdx
# The licences of one family, with versions and the dates that head their texts.
GNU = {
    "gpl": ("GPL", "gnu general public license", {"1": "february 1989", "2": "june 1991", "3": "29 june 2007"}),
    "library": ("LGPL", "gnu library general public license", {"2": "june 1991"}),
    "lgpl": ("LGPL", "gnu lesser general public license", {"2": "", "2 1": "february 1999", "3": "29 june 2007"}),
    "agpl": ("AGPL", "gnu affero general public license", {"3": "19 november 2007"}),
}
TERMS = "you can redistribute it and or modify it under the terms of"
PUBLISHED = "as published by the free software foundation"
# a notice is this and a name
NOTICE = (r"^(?:this (?:work|software|file|project|program|document|library|package|code|font software|site) is )?"
          r"(?:licensed|released|distributed|available|made available|published) under "
          r"(?:the terms of )?(?:the |a )?(.+)$")
# Sentences of the licence texts themselves.
SENTENCES = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                 "associated documentation files the software to deal in the software without restriction including "
                 "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
                 "copies of the software and to permit persons to whom the software is furnished to do so subject to "
                 "the following conditions",
    "mit-0-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                   "associated documentation files the software to deal in the software without restriction including "
                   "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
                   "copies of the software and to permit persons to whom the software is furnished to do so",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or "
                  "substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not "
                 "limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other "
                     "liability whether in an action of contract tort or otherwise arising from out of or in "
                     "connection with the software or the use or other dealings in the software",
    "json-good": "the software shall be used for good not evil",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is "
                 "hereby granted provided that the above copyright notice and this permission notice appear in all "
                 "copies",
    "isc-grant-and": "permission to use copy modify and distribute this software for any purpose with or without fee is "
                     "hereby granted provided that the above copyright notice and this permission notice appear in all "
                     "copies",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is "
                  "hereby granted",
    "apache-header": "licensed under the apache license version 2 0 the license",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-title": "apache license",
    "apache-dated": "version 2 0 january 2004",
    "apache-head": "apache license version 2 0 january 2004 http www apache org licenses",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted "
                 "provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and "
                  "the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions "
                  "and the following disclaimer in the documentation and or other materials provided with the "
                  "distribution",
    "bsd-advert": "all advertising materials mentioning features or use of this software must display the following "
                  "acknowledgement",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse "
                   "or promote products derived from this software without specific prior written permission",
    "bsd-clear": "no express or implied licenses to any party s patent rights are granted by this license",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial "
                  "applications and to alter it and redistribute it freely subject to the following restrictions",
    "bsl-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the "
                 "software and accompanying documentation covered by this license the software to use reproduce "
                 "display distribute execute and transmit the software and to prepare derivative works of the "
                 "software and to permit third parties to whom the software is furnished to do so all subject to the "
                 "following",
    "postgresql-grant": "permission to use copy modify and distribute this software and its documentation for any "
                        "purpose without fee and without a written agreement is hereby granted provided that the above "
                        "copyright notice and this paragraph and the following two paragraphs appear in all copies",
    "mpl-form": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-2-title": "mozilla public license version 2 0",
    "mpl-11-title": "mozilla public license version 1 1",
    "epl-2-title": "eclipse public license v 2 0",
    "epl-1-title": "eclipse public license v 1 0",
    "bsl-title": "boost software license version 1 0 august 17th 2003",
    "ofl-title": "sil open font license version 1 1 26 february 2007",
    "artistic-title": "the artistic license 2 0",
    "eupl-title": "european union public licence v 1 2",
    "cc0-title": "cc0 1 0 universal",
    "wtfpl-title": "do what the fuck you want to public license",
    "unlicense-domain": "this is free and unencumbered software released into the public domain",
    "gnu-appendix": "how to apply these terms to your new programs",
    "gnu-appendix-libraries": "how to apply these terms to your new libraries",
}
# Sentences with a gap (a holder's name): start, middle and end; each may be empty.
GAPPED = [
    ("bsd-endorse", "neither the name ", "", " may be used to endorse or promote products derived from this software "
                                             "without specific prior written permission"),
    ("bsd-endorse", "the name ", "", " may not be used to endorse or promote products derived from this software "
                                     "without specific prior written permission"),
    ("bsd-endorse", "the names ", "", " may not be used to endorse or promote products derived from this software "
                                      "without specific prior written permission"),
    ("bsd-advert", "all advertising materials mentioning features or use of this software must display the following ",
     "", "ment"),
    ("mit-liability", "in no event shall ", "", " be liable for any claim damages or other liability whether in an "
                      "action of contract tort or otherwise arising from out of or in connection with the software or "
                      "the use or other dealings in the software"),
    ("x11-promote", "except as contained in this notice the name", " shall not be used in advertising or otherwise to "
                    "promote the sale use or other dealings in this software without prior written authorization ", ""),
]
# A licence text is recognised by its sentences in order, with no other known one between. A rule
# without a licence forbids the shorter ones within it.
SEQUENCES = {
    "mit-text": ("MIT", ["mit-grant", "mit-notice", "mit-as-is", "mit-liability"]),
    "mit-grant-only": ("MIT", ["mit-grant"]),
    "mit-0-text": ("MIT-0", ["mit-0-grant"]),
    "json-text": ("JSON", ["mit-grant", "mit-notice", "json-good", "mit-as-is", "mit-liability"]),
    "json-grant-only": ("JSON", ["mit-grant", "mit-notice", "json-good"]),
    "x11-text": ("X11", ["mit-grant", "mit-notice", "mit-as-is", "mit-liability", "x11-promote"]),
    "isc-text": ("ISC", ["isc-grant"]),
    "isc-text-and": ("ISC", ["isc-grant-and"]),
    "0bsd-text": ("0BSD", ["0bsd-grant"]),
    "apache-header": ("Apache-2.0", ["apache-header", "apache-use", "apache-copy"]),
    "apache-header-start": ("Apache-2.0", ["apache-header"]),
    "apache-text": ("Apache-2.0", ["apache-title", "apache-dated"]),
    "apache-text-head": ("Apache-2.0", ["apache-head"]),
    "bsd-2-text": ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    "bsd-3-text": ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    "bsd-3-clear-text": ("BSD-3-Clause-Clear", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-clear"]),
    "bsd-4-text": ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse"]),
    "bsd-4-start": ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advert"]),
    "zlib-text": ("Zlib", ["zlib-grant"]),
    "bsl-text": ("BSL-1.0", ["bsl-grant"]),
    "postgresql-text": ("PostgreSQL", ["postgresql-grant"]),
    "mpl-2-header": ("MPL-2.0", ["mpl-form"]),
    "mpl-2-text": ("MPL-2.0", ["mpl-2-title"]),
    "mpl-11-text": ("MPL-1.1", ["mpl-11-title"]),
    "epl-2-text": ("EPL-2.0", ["epl-2-title"]),
    "epl-1-text": ("EPL-1.0", ["epl-1-title"]),
    "bsl-head": ("BSL-1.0", ["bsl-title"]),
    "ofl-text": ("OFL-1.1", ["ofl-title"]),
    "artistic-text": ("Artistic-2.0", ["artistic-title"]),
    "eupl-text": ("EUPL-1.2", ["eupl-title"]),
    "cc0-text": ("CC0-1.0", ["cc0-title"]),
    "wtfpl-text": ("WTFPL", ["wtfpl-title"]),
    "unlicense-text": ("Unlicense", ["unlicense-domain"]),
}
# An SPDX tag: identifiers joined by operators, with brackets.
SPDX_TAG = "SPDX-License-Identifier:"
_SPDX_ID = r"(?:\([\x20\t]*)*[A-Za-z0-9](?:[A-Za-z0-9.:-]*[A-Za-z0-9])?\+?(?:[\x20\t]*\))*"
SPDX = rf"{SPDX_TAG}[\x20\t]*({_SPDX_ID}(?:[\x20\t]+(?:AND|OR|WITH)[\x20\t]+{_SPDX_ID})*)"
SPDX_RULE = "spdx-expression"
# what is no licence in an expression: brackets, and an exception with its operator
SPDX_ASIDE = r"[()]|[\x20\t]WITH[\x20\t]+[^\x20\t)]+"
SPDX_AND_OR = r"[\x20\t]+(?:AND|OR)[\x20\t]+"


def spdx_version(version: str) -> str:
    return version.replace(" ", ".") if " " in version else f"{version}.0"


def _gnu_parts() -> tuple[dict[str, str], dict[str, str], dict[str, tuple[str, list[str]]]]:
    """Names, sentences (text -> identifier) and rules of the family, by its common wordings."""
    names, known, rules = {}, {}, {}
    for key, (stem, name, versions) in GNU.items():
        known[f"{TERMS} the {name} {PUBLISHED}"] = f"{key}-terms"
        known[name] = f"{key}-title"
        for v, date in versions.items():
            spdx, tag = f"{stem}-{spdx_version(v)}", f"{key}-{v.replace(' ', '.')}"
            dotted = [v] if " " in v else [v, f"{v} 0"]
            for alias in (name, f"gnu {stem.lower()}", stem.lower()):
                for form in [f"{w} {x}" for x in dotted for w in ("version", "v")] + [f"v{x}" for x in dotted] + [f"{x}" for x in dotted]:
                    names.setdefault(f"{alias} {form}", f"{spdx}-only")
                    names.setdefault(f"{alias} {form} or later", f"{spdx}-or-later")
            later, version = f"later-{v.replace(' ', '.')}", f"version-{v.replace(' ', '.')}"
            known[f"either version {v} of the license or at your option any later version"] = later
            known[f"version {v} of the license"] = version
            known[f"{TERMS} the {name} {PUBLISHED} either version {v} of the license or at your option any later version"] = f"{tag}-later"
            for text in (f"the {name} {PUBLISHED} version {v}", f"the {name} {PUBLISHED} version {v} of the license",
                         f"the {name} version {v} {PUBLISHED}", f"version {v} of the {name} {PUBLISHED}"):
                known[f"{TERMS} {text}"] = f"{tag}-only"
            forms = {"later": (f"{spdx}-or-later", [[f"{key}-terms", later], [f"{tag}-later"]]),
                     "only": (f"{spdx}-only", [[f"{key}-terms", version], [f"{tag}-only"]])}
            for form, (license, sequences) in forms.items():
                for n, ids in enumerate(sequences):
                    rules[f"{tag}-{form}-{n + 1}"] = (license, ids)
                    for end in ("", "-libraries"):  # a sample header at the end of the licence's own text
                        rules[f"{tag}-{form}-{n + 1}-sample{end}"] = ("", [f"gnu-appendix{end}", *ids])
            if date:
                known[f"{name} version {v} {date}"] = f"{tag}-head"
                known[f"version {v} {date}"] = f"dated-{v.replace(' ', '.')}-{date.replace(' ', '-')}"
                rules[f"{tag}-text"] = (f"{spdx}-only", [f"{key}-title", known[f"version {v} {date}"]])
                rules[f"{tag}-text-head"] = (f"{spdx}-only", [f"{tag}-head"])
    return names, known, rules


@dataclass(frozen=True)
class Rule:
    name: str
    license: str
    sentences: tuple[str, ...]


def known_names() -> dict[str, str]:
    """Licence name as a notice writes it -> SPDX identifier."""
    return {**_gnu_parts()[0], **NAMES}


def known_sentences() -> dict[str, str]:
    """Normalised sentence without gaps -> identifier."""
    titles = {title: f"notice-{spdx}" for title, spdx in CC_TITLES.items()}
    return {**titles, **_gnu_parts()[1], **{text: name for name, text in SENTENCES.items()}}


def license_rules() -> list[Rule]:
    """Ordered rules; where one's sequence lies within another's, the longer stands first.

    A notice or the title of a licence's text, whose identifier holds the licence, is a rule of its own and not listed.
    """
    rules = [Rule(name, license, tuple(ids)) for name, (license, ids) in {**SEQUENCES, **_gnu_parts()[2]}.items()]
    return sorted(rules, key=lambda r: (-len(r.sentences), r.name))


def spdx_identifiers() -> dict[str, str]:
    """Identifiers in lower case -> as SPDX writes them now; the family's short ones had no ending before."""
    licenses = [r.license for r in license_rules() if r.license] + list(known_names().values()) + list(CC_TITLES.values())
    found = {spdx.lower(): spdx for spdx in licenses}
    for stem, _, versions in GNU.values():
        for v in versions:
            spdx = f"{stem}-{spdx_version(v)}"
            found |= {spdx.lower(): f"{spdx}-only", f"{spdx.lower()}+": f"{spdx}-or-later",
                      f"{spdx.lower()}-only": f"{spdx}-only", f"{spdx.lower()}-or-later": f"{spdx}-or-later"}
    return found


def _within(inner: tuple[str, ...], outer: tuple[str, ...]) -> bool:
    return any(outer[i:i + len(inner)] == inner for i in range(len(outer) - len(inner) + 1))


def _quoted(text: str) -> str:
    """A literal that the engine takes as it is written."""
    return "r'" + text + "'" if "'" not in text else 'r"' + text + '"'


def _lookup(pairs: dict[str, str], key: str) -> str:
    """The value of a key in a fixed table, null where it has none."""
    table = ", ".join(_quoted(x) for pair in pairs.items() for x in pair)
    return f"case when {key} in ({', '.join(map(_quoted, pairs))}) then try_element_at(map({table}), {key}) end"


def _identifier(sentence: str, known: dict[str, str], names: dict[str, str]) -> str:
    """A known sentence's identifier: of a whole one, of one with a gap, or of a notice with its licence."""
    gapped = " ".join(
        f"when startswith({sentence}, '{start}') and endswith({sentence}, '{end}') and contains({sentence}, '{middle}') "
        f"and char_length({sentence}) > {len(start + middle + end)} then '{id}'" for id, start, middle, end in GAPPED)
    name = f"regexp_extract({sentence}, {_quoted(NOTICE)}, 1)"
    notice = f"case when contains({sentence}, ' under ') then concat('notice-', {_lookup(names, name)}) end"
    return f"coalesce({_lookup(known, sentence)}, case {gapped} end, {notice})"


def _hits(text: str, cut: str, known: dict[str, str], names: dict[str, str]) -> Column:
    """Number and identifier of the known sentences of a column of texts.

    Sentences are normalised: lower case, and every run of other characters than a-z and 0-9 is one space. The
    tables are written as SQL, as a column for each of their entries would take the driver many seconds.
    """
    normal = f"trim(regexp_replace(lower(s), '{NOT_PLAIN}', ' '))"
    numbered = f"transform(split({text}, {_quoted(cut)}, -1), (s, i) -> struct(i as number, {normal} as sentence))"
    named = f"transform({numbered}, s -> struct(s.number as number, {_identifier('s.sentence', known, names)} as id))"
    return F.expr(f"filter({named}, s -> s.id is not null)")


def _expressions(text: Column) -> Column:
    """The SPDX expressions of a text, with single spaces."""
    found = F.transform(F.regexp_extract_all(text, F.lit(SPDX), F.lit(1)), lambda x: F.regexp_replace(x, r"[\x20\t]+", " "))
    return F.when(text.contains(SPDX_TAG), found).otherwise(F.array().cast("array<string>"))


def _expression_licenses(expressions: Column) -> Column:
    """The licences that expressions name; unknown identifiers stay as they are written."""
    ids = F.flatten(F.transform(expressions, lambda x: F.split(F.trim(F.regexp_replace(x, SPDX_ASIDE, "")), SPDX_AND_OR)))
    table = spdx_identifiers()
    pairs = F.expr(f"map({', '.join(_quoted(x) for pair in table.items() for x in pair)})")
    return F.transform(ids, lambda x: F.coalesce(F.try_element_at(pairs, F.lower(F.trim(x))), F.trim(x)))


def _sequence(rule: Rule) -> str:
    return "".join(f" {s} " for s in rule.sentences)


def _match(rule: Rule, rules: list[Rule], views: tuple[str, str]) -> str:
    """Does the rule's sequence stand in a view outside the longer rules that contain it? As SQL.

    A longer text that only the other view has whole may show in part here: as many places do not count.
    """
    def times(view: str, r: Rule) -> str:
        return f"((length({view}) - length(replace({view}, '{_sequence(r)}', ''))) / {len(_sequence(r))})"

    longer = [r for r in rules if len(r.sentences) > len(rule.sentences) and _within(rule.sentences, r.sentences)]
    left, hidden = list(views), ["0", "0"]
    for outer in sorted(longer, key=lambda r: -len(r.sentences)):
        counts = [times(v, outer) for v in left]
        hidden = [f"{hidden[n]} + greatest({counts[1 - n]} - {counts[n]}, 0)" for n in (0, 1)]
        left = [f"replace({v}, '{_sequence(outer)}', ' . ')" for v in left]
    return " or ".join(f"{times(left[n], rule)} > {hidden[n]}" for n in (0, 1))


def scan(docs: DataFrame, known: dict[str, str] | None = None, rules: list[Rule] | None = None,
         names: dict[str, str] | None = None) -> DataFrame:
    """doc_id, sentences and wrapped (number and identifier of each known sentence), expressions, rules and licenses.

    `sentences` are cut at line ends and after marks; `wrapped` are cut in the text with single line ends
    as spaces, for licence texts that are broken into lines; lines of white space or comment marks only part
    them. Carriage returns count as line ends. Each is normalised and looked up among the
    known ones. A rule matches where its identifiers follow one another in one of the two sequences
    of known sentences, whatever unknown text lies between; where its identifiers lie within those of a
    longer rule at the same place it does not match there; a rule without a licence only forbids the shorter ones.
    Sentences may have a gap for a holder's name; a notice is any wording of `NOTICE` before a known name. Tags
    give their SPDX expression and its identifiers; those that no rule knows are reported as written, exceptions
    (WITH) are part of the expression only. Everything happens next to the row: no shuffle, and a hot source or many
    copies cost no more than other rows. Null and empty texts give empty arrays, repeated rows give
    one row each, a missing doc_id is kept, other columns are not read, an empty table gives no rows.
    """
    known = known_sentences() if known is None else known
    rules = license_rules() if rules is None else rules
    names = known_names() if names is None else names
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n?", "\n")
    plain = docs.select("doc_id", F.regexp_replace(text, ABBREVIATION, "$1$2").alias("__text"))
    joined = F.regexp_replace(F.regexp_replace("__text", EMPTY_LINES, GAP), LEADING_MARKS, "$1")
    joined = plain.withColumn("__joined", F.replace(joined, F.lit("\n"), F.lit(" ")))
    found = joined.select("doc_id", _hits("__text", CUT, known, names).alias("sentences"),
                          _hits("__joined", CUT_WRAPPED, known, names).alias("wrapped"),
                          _expressions(F.col("__text")).alias("expressions"))
    views = ("__sentences", "__wrapped")
    for view in views:
        ids = F.transform(view[2:], lambda s: F.concat(F.lit(" "), s["id"], F.lit(" ")))
        found = found.withColumn(view, F.array_join(ids, ""))
    none = "cast(array() as array<struct<rule:string,license:string>>)"
    matches = ", ".join(f"if({_match(r, rules, views)}, struct('{r.name}' as rule, '{r.license}' as license), null)"
                        for r in rules if r.license)
    notices = ("transform(array_sort(array_distinct(filter(concat(sentences.id, wrapped.id), x -> x like 'notice-%'))), "
               "x -> struct(x as rule, substring(x, 8) as license))")
    # most documents have no known sentence: their rules are not tried
    tried = f"concat(array_compact(array({matches})), {notices})" if matches else notices
    found = found.withColumn("__matches", F.expr(f"if(size(sentences) + size(wrapped) > 0, {tried}, {none})"))
    tagged = F.when(F.size("expressions") > 0, F.array(F.lit(SPDX_RULE))).otherwise(F.array().cast("array<string>"))
    licenses = F.concat(F.col("__matches.license"), _expression_licenses(F.col("expressions")))
    return found.select("doc_id", "sentences", "wrapped", "expressions",
                        F.concat(F.col("__matches.rule"), tagged).alias("rules"),
                        F.array_sort(F.array_distinct(licenses)).alias("licenses"))


def digest(found: DataFrame) -> DataFrame:
    """The scan as plain columns: number:identifier of the sentences, expressions, rules and licences, comma-joined."""
    def listed(name: str) -> Column:
        return F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["number"].cast("string"), s["id"])), ",")

    return found.select(
        "doc_id", F.size("sentences").cast("long").alias("n_sentences"), listed("sentences").alias("sentences"),
        listed("wrapped").alias("wrapped"), F.array_join("expressions", ",").alias("expressions"), F.array_join("rules", ",").alias("rules"),
        F.array_join("licenses", ",").alias("licenses"))


def _oracle() -> str:
    """SQL for `digest`: the sentences as rows, known ones and names as tables, the rules as tests of joined identifiers."""
    def table(pairs: dict[str, str]) -> str:
        return ",\n".join(f"('{k}', '{v}')" for k, v in pairs.items())

    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    # the engine's expressions look neither ahead nor back: a mark before white space is marked with the cut sign
    def cut(text: str, sign: str) -> str:
        marked = f"regexp_replace({text}, '([.!?;:])[ \\t\\n\\x0B\\f\\r]+', '\\1' || {sign}, 'g')"
        return f"string_split_regex({marked}, {sign} || '+')"

    gaps = "\n".join(f"when starts_with(s, '{a}') and ends_with(s, '{z}') and contains(s, '{m}') "
                     f"and length(s) > {len(a + m + z)} then '{id}'" for id, a, m, z in GAPPED)
    rules = license_rules()
    tests = ",\n".join(f"case when {_match(r, rules, ("a", "b"))} then {{'rule': '{r.name}', 'license': '{r.license}'}} end"
                       for r in rules if r.license)
    return f"""with known(sentence, id) as (values {table(known_sentences())}),
names(name, spdx) as (values {table(known_names())}),
written(lower_id, spdx) as (values {table(spdx_identifiers())}),
d as (select row_number() over () as k, doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'),
  {quoted(ABBREVIATION)}, '\\1\\2', 'g') as text from documents),
j as (select k, replace(regexp_replace(regexp_replace(text, {quoted(EMPTY_LINES)}, chr(1), 'g'),
  {quoted(LEADING_MARKS)}, '\\1', 'g'), chr(10), ' ') as text from d),
views as (select k, 0 as view, {cut("text", "chr(10)")} as parts from d
  union all select k, 1, {cut("text", "chr(1)")} from j),
cut as (select k, view, generate_subscripts(parts, 1) - 1 as number, unnest(parts) as part from views),
plain as (select k, view, number, trim(regexp_replace(lower(part), '[^a-z0-9]+', ' ', 'g')) as s from cut),
hits as (select p.k, p.view, p.number, coalesce(w.id, case {gaps} end, 'notice-' || n.spdx) as id
  from plain p left join known w on p.s = w.sentence
  left join names n on contains(p.s, ' under ') and regexp_extract(p.s, {quoted(NOTICE)}, 1) = n.name),
found as (select * from hits where id is not null),
per_view as (select k, view, count(*) as n, string_agg(number || ':' || id, ',' order by number) as sentences,
  string_agg(' ' || id || ' ', '' order by number) as ids from found group by k, view),
seq as (select k, coalesce(max(n) filter (where view = 0), 0) as n,
  coalesce(max(sentences) filter (where view = 0), '') as sentences,
  coalesce(max(sentences) filter (where view = 1), '') as wrapped,
  coalesce(max(ids) filter (where view = 0), '') as a, coalesce(max(ids) filter (where view = 1), '') as b
  from per_view group by k),
notices as (select k, list({{'rule': id, 'license': substring(id, 8)}} order by id) as m
  from (select distinct k, id from found where id like 'notice-%') group by k),
matched as (select k, list_concat(list_filter([{tests}], lambda m: m is not null), coalesce(n.m, [])) as m
  from seq left join notices n using (k)),
tags as (select k, list_transform(regexp_extract_all(text, {quoted(SPDX)}, 1),
  lambda x: regexp_replace(x, '[ \\t]+', ' ', 'g')) as expressions from d where contains(text, '{SPDX_TAG}')),
tokens as (select k, trim(unnest(flatten(list_transform(expressions, lambda x: string_split_regex(
  trim(regexp_replace(x, {quoted(SPDX_ASIDE)}, '', 'g')), {quoted(SPDX_AND_OR)}))))) as token from tags),
named as (select k, list(coalesce(spdx, token)) as ids from tokens left join written on lower(token) = lower_id group by k)
select doc_id, coalesce(seq.n, 0) as n_sentences, coalesce(sentences, '') as sentences, coalesce(wrapped, '') as wrapped,
  coalesce(array_to_string(expressions, ','), '') as expressions,
  array_to_string(list_concat(coalesce(list_transform(m, lambda x: x.rule), []),
    case when len(expressions) > 0 then ['{SPDX_RULE}'] else [] end), ',') as rules,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(list_transform(m, lambda x: x.license), []),
    coalesce(ids, [])))), ',') as licenses
from d left join seq using (k) left join matched using (k) left join tags using (k) left join named using (k)"""


ORACLE = _oracle()
