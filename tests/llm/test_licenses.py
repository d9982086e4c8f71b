import duckdb

from plantpulse.llm import licenses
from tests.llm.cases import docs, odd_texts

MIT = [licenses.SENTENCES[k] for k in ("mit-grant", "mit-notice", "mit-as-is", "mit-liability")]
BSD = [licenses.SENTENCES[k] for k in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")]

# published wordings
GPL = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} Public "
       "License as published by the Free Software Foundation{} {}.")
LATER = "either version {} of the License, or (at your option) any later version"
MIT_TEXT = """Copyright (c) 2002 JSON.org

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
{}
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
{}"""
AUTHORS = "THE\nAUTHORS OR COPYRIGHT HOLDERS"
BSD_TEXT = """Copyright (c) 1990, 1993
The Regents of the University of California.  All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:
1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS ``AS IS'' AND
ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
"""
ADVERT = """3. All advertising materials mentioning features or use of this software
   must display the following acknowledgement:
   This product includes software developed by the University of
   California, Berkeley and its contributors.
"""
ENDORSE = """4. Neither the name of {} nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
"""
X11 = """
Except as contained in this notice, the name of the X Consortium shall not be
used in advertising or otherwise to promote the sale, use or other dealings
in this Software without prior written authorization from the X Consortium.
"""
PUBLISHED = {
    "University": (BSD_TEXT.format(ENDORSE.format("the University")), ["BSD-3-Clause"]),
    "company": (BSD_TEXT.format(ENDORSE.format("Example Widgets, Inc.")), ["BSD-3-Clause"]),
    "author": (BSD_TEXT.format("3. The name of the author may not be used to endorse or promote products derived from "
                               "this software without specific prior written permission.\n"), ["BSD-3-Clause"]),
    "advertising": (BSD_TEXT.format(ADVERT + ENDORSE.format("the University")), ["BSD-4-Clause"]),
    "advertising, US": (BSD_TEXT.format(ADVERT.replace("ement", "ment")), ["BSD-4-Clause"]),
    "two clauses": (BSD_TEXT.format(""), ["BSD-2-Clause"]),
    "clear": (BSD_TEXT.format(ENDORSE.format("X") + "NO EXPRESS OR IMPLIED LICENSES TO ANY PARTY'S PATENT RIGHTS ARE "
                              "GRANTED BY THIS LICENSE."), ["BSD-3-Clause-Clear"]),
    "mit": (MIT_TEXT.format("", AUTHORS, ""), ["MIT"]),
    "mit of a firm": (MIT_TEXT.format("", "EXAMPLE\nWIDGETS", ""), ["MIT"]),
    "json": (MIT_TEXT.format("\nThe Software shall be used for Good, not Evil.\n", AUTHORS, ""), ["JSON"]),
    "x11": (MIT_TEXT.format("", AUTHORS, X11), ["X11"]),
    "mit-0": (MIT_TEXT[:MIT_TEXT.index(", subject to")] + ".\n", ["MIT-0"]),
    "gpl 2": ("This program is free software; " + GPL.format("General", ";", LATER.format("2"))[31:], ["GPL-2.0-or-later"]),
    "gpl 2 only": (GPL.format("General", ";", "version 2 of the License"), ["GPL-2.0-only"]),
    "gpl 2 first": ("This file is free software; you can redistribute it and/or modify it under the terms of version 2 of "
                    "the GNU General Public License as published by the Free Software Foundation.", ["GPL-2.0-only"]),
    "gpl 3": (GPL.format("General", ",", LATER.format("3")), ["GPL-3.0-or-later"]),
    "gpl 3 only": (GPL.format("General", ",", "version 3"), ["GPL-3.0-only"]),
    "lgpl 2.1": (GPL.format("Lesser General", ";", LATER.format("2.1")), ["LGPL-2.1-or-later"]),
    "lgpl 2": (GPL.format("Library General", ";", LATER.format("2")), ["LGPL-2.0-or-later"]),
    "lgpl 3": (GPL.format("Lesser General", ",", LATER.format("3")), ["LGPL-3.0-or-later"]),
    "agpl 3": (GPL.format("Affero General", ",", LATER.format("3")), ["AGPL-3.0-or-later"]),
    "gpl 3 text": ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n "
                   "Copyright (C) 2007 Free Software Foundation, Inc.\n\n            How to Apply These Terms to Your New "
                   "Programs\n\n" + GPL.format("General", ",", LATER.format("3")), ["GPL-3.0-only"]),
    "lgpl 2.1 text": ("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999\n\nHow to Apply These Terms to Your "
                      "New Libraries\n\n" + GPL.format("Lesser General", ";", LATER.format("2.1")), ["LGPL-2.1-only"]),
    "apache text": ("                                 Apache License\n                           Version 2.0, January 2004\n"
                    "                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS", ["Apache-2.0"]),
    "mpl text": ("Mozilla Public License Version 2.0\n==================================\n\n1. Definitions", ["MPL-2.0"]),
    "epl": ("Eclipse Public License - v 2.0\n\n    THE ACCOMPANYING PROGRAM", ["EPL-2.0"]),
    "boost": ("Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission", ["BSL-1.0"]),
    "zlib": ("Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to "
             "alter it and redistribute it\nfreely, subject to the following restrictions:", ["Zlib"]),
    "isc": ("Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby "
            "granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", ["ISC"]),
    "0bsd": ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is "
             "hereby granted.", ["0BSD"]),
    "cc title": ("Attribution-ShareAlike 4.0 International\n\nBy exercising", ["CC-BY-SA-4.0"]),
    "cc notice": ("This work is licensed under a Creative Commons Attribution-NonCommercial 3.0 Unported License.",
                  ["CC-BY-NC-3.0"]),
    "lgpl notice": ("This library is distributed under the terms of the GNU LGPL v2.1 or later.", ["LGPL-2.1-or-later"]),
    "epl notice": ("Made available under the Eclipse Public License v1.0.", ["EPL-1.0"]),
    "either": ("// SPDX-License-Identifier: MIT OR Apache-2.0\nint x;", ["Apache-2.0", "MIT"]),
    "brackets": ("/* SPDX-License-Identifier: (GPL-2.0 WITH Linux-syscall-note) AND\tbsd-3-clause */",
                 ["BSD-3-Clause", "GPL-2.0-only"]),
    "old ends": ("# SPDX-License-Identifier: GPL-2.0+\n# SPDX-License-Identifier: LGPL-2.1-or-later.",
                 ["GPL-2.0-or-later", "LGPL-2.1-or-later"]),
    "unknown": ("SPDX-License-Identifier: LicenseRef-Own-1 OR MIT-->", ["LicenseRef-Own-1", "MIT"]),
    "no tag": ("SPDX-License-Identifier:\nSPDX-License-Identifier: (", []),
}


def found(spark, *texts):
    rows = licenses.scan(docs(spark, list(enumerate(texts)))).collect()
    return [(r.rules, r.licenses) for r in sorted(rows, key=lambda r: r.doc_id)]


def test_notices(spark):
    assert found(spark, "Text.\nLicensed under CC BY-NC 4.0.\nMore", "It is so. Released under the MIT License. Yes",
                 "This work is licensed under the GNU General Public License, version 3.", "we like the MIT License.",
                 "SPDX-License-Identifier: BSD-2-Clause") == [
        (["notice-CC-BY-NC-4.0"], ["CC-BY-NC-4.0"]), (["notice-MIT"], ["MIT"]), (["notice-GPL-3.0-only"], ["GPL-3.0-only"]),
        ([], []), (["spdx-expression"], ["BSD-2-Clause"])]


def marked(text):
    return [text, text.replace("\n", "\r\n"), "\n".join("# " + x for x in text.split("\n"))]


def test_published_wordings(spark):
    got = found(spark, *[t for text, _ in PUBLISHED.values() for t in marked(text)])
    wrong = {(name, n): got[3 * i + n] for i, (name, (_, want)) in enumerate(PUBLISHED.items())
             for n in range(3) if got[3 * i + n][1] != want}
    assert not wrong


def test_sql_of_published_wordings(spark):
    """Also with texts behind one another, and texts that the other tests use."""
    texts = [t for text, _ in PUBLISHED.values() for t in marked(text)]
    texts += [a + "\n\n" + b for a, b in zip(texts, texts[7:])] + [m for x in odd_texts() for m in [x[1]]]
    texts += [";; " + "\n;; ".join(MIT), "a\n\n\n", "x. \n # \n\n; y", None, "", ". ".join([MIT[0], *MIT])]
    table = docs(spark, list(enumerate(texts)))
    ours = licenses.digest(licenses.scan(table))
    names = ours.columns
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [(n, t) for n, t in enumerate(texts)])
    theirs = sorted(con.execute(f"select {', '.join(names)} from ({licenses.ORACLE})").fetchall())
    assert theirs == sorted(tuple(r) for r in ours.collect())


def test_ordered_sentences(spark):
    whole, part = ".\n".join(MIT).upper(), ". ".join([MIT[0], "Something else", *MIT[1:]])
    wrong = ". ".join([MIT[1], MIT[0], MIT[2], MIT[3]])
    assert found(spark, whole, part, wrong, "; ".join(BSD), "; ".join(BSD[:3]), "; ".join(BSD[1:])) == [
        (["mit-text"], ["MIT"]), (["mit-text"], ["MIT"]), (["mit-grant-only"], ["MIT"]), (["bsd-3-text"], ["BSD-3-Clause"]),
        (["bsd-2-text"], ["BSD-2-Clause"]), ([], [])]


def test_wrapped_lines(spark):
    lines = "\n".join(" ".join(x.split()[i:i + 9]) for x in [m + "." for m in MIT] for i in range(0, len(x.split()), 9))
    mixed = "Intro without end\n\n" + lines + "\n\nLicensed under CC BY 4.0"
    assert found(spark, lines, mixed) == [(["mit-text"], ["MIT"]), (["mit-text", "notice-CC-BY-4.0"], ["CC-BY-4.0", "MIT"])]


def test_wrapped_lines_after_other_empty_lines(spark):
    def wrap(text):
        return "\n".join(" ".join(text.split()[i:i + 9]) for i in range(0, len(text.split()), 9))

    gpl = GPL.format("General", ",", "either version 3 of the License, or (at your option) any later version")
    text = "MIT License\n\nCopyright (c) 2020 Foo\n\n" + "\n\n".join(wrap(m + ".") for m in MIT)
    lines, other = text.split("\n"), ("tool - does things\n\nCopyright 2020 Foo\n\n" + wrap(gpl)).split("\n")
    forms = ["\r\n".join, "\r".join, lambda x: "\n".join(t or " \t" for t in x), lambda x: "\r\n".join(t or "  " for t in x)]
    for mark in ("#", "# ", " * ", "// ", "--", ";; ", "% "):
        forms.append(lambda x, mark=mark: "\n".join(mark + t for t in x))
    forms.append(lambda x: "/*\n" + "\n".join((" * " + t).rstrip() for t in x) + "\n */\ncode")
    got = found(spark, *[f(x) for f in forms for x in (lines, other)])
    assert got == [(["mit-text"], ["MIT"]), (["gpl-3-later-2"], ["GPL-3.0-or-later"])] * len(forms)


def test_a_shorter_text_beside_a_longer_one(spark):
    def wrapped(sentences):
        return "\n".join(" ".join(x.split()[i:i + 9]) for x in [m + "." for m in sentences] for i in range(0, len(x.split()), 9))

    both = (["bsd-3-text", "bsd-2-text"], ["BSD-2-Clause", "BSD-3-Clause"])
    two, three = "; ".join(BSD[:3]) + ".", "; ".join(BSD) + "."
    partly = ";\n".join(BSD[:3]) + ";\n" + wrapped(BSD[3:])
    assert found(spark, f"{two}\n\nOther\n\n{three}", f"{three}\n\n{two}", f"{two}\n\n{three}\n\n{two}\n\n{three}",
                 wrapped(BSD) + "\n\n" + wrapped(BSD[:3]), f"{three}\n\n{three}", partly, f"{partly}\n\n{two}",
                 f"{MIT[0]}.\n" + ".\n".join(MIT)) == [
        both, both, both, both, (["bsd-3-text"], ["BSD-3-Clause"]), (["bsd-3-text"], ["BSD-3-Clause"]), both,
        (["mit-text", "mit-grant-only"], ["MIT"])]


def test_positions_and_several_licenses(spark):
    row = licenses.scan(docs(spark, [(1, "a\n\nReleased under the MIT License.\nb. Licensed under CC BY 4.0. Released under the MIT "
                                         "License.")])).first()
    assert [(s.number, s.id) for s in row.sentences] == [(1, "notice-MIT"), (3, "notice-CC-BY-4.0"), (4, "notice-MIT")]
    assert row.licenses == ["CC-BY-4.0", "MIT"]


def test_odd_rows_and_empty_table(spark):
    rows = licenses.scan(docs(spark, odd_texts())).collect()
    assert len(rows) == len(odd_texts()) and all(r.licenses == [] and r.sentences == [] for r in rows)
    assert licenses.scan(docs(spark, [])).count() == 0
    assert licenses.digest(licenses.scan(docs(spark, [(1, None)]))).first().licenses == ""


def test_plan_is_narrow_and_native(spark, sf, capsys):
    licenses.scan(spark.read.parquet(f"{sf}/documents.parquet")).explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
