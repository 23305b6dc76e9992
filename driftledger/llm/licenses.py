"""Licence recognition by sentence rules, with DataFrame functions only.

Each document's sentences are normalised and mapped to the identifiers of known
licence sentences; the identifiers, in order, are matched against ordered rules.
A tag with an SPDX expression (``A OR (B AND C WITH d)``) is a sentence for each of its licences.
All of it happens in the document's own row, so nothing is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

#: Known sentences of public licences, normalised: lower-case words and numbers with
#: single spaces.  Fixed values.  ``{v}`` stands for each version of the family.
SENTENCES: dict[str, str] = {
    "mit-ref": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-title": "the mit license",
    "mit-title-paren": "the mit license mit",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "asis-software": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache-ref:{v}": "licensed under the apache license version {v}",
    "apache-the:{v}": "licensed under the apache license version {v} the license",
    "apache-may": "you may not use this file except in compliance with the license",
    "apache-obtain": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-unless": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl-work:{v}": "this work is licensed under the gnu general public license version {v}",
    "gpl-licensed:{v}": "licensed under the gnu general public license version {v}",
    "gpl-free:{v}": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {v} of the license or at your option any later version",
    "lgpl-work:{v}": "this work is licensed under the gnu lesser general public license version {v}",
    "agpl-work:{v}": "this work is licensed under the gnu affero general public license version {v}",
    "mpl-form:{v}": "this source code form is subject to the terms of the mozilla public license v {v}",
    "bsd-redist": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "lgpl-free:{v}": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version {v} of the license or at your option any later version",
    "lgpl-program:{v}": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version {v} of the license or at your option any later version",
    "agpl-free:{v}": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version {v} of the license or at your option any later version",
    "bsd-advert": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-author": "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-asis": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc-asis": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "mit0-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    "zlib-asis": "this software is provided as is without any express or implied warranty",
    "zlib-liable": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "bsl-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "bsl-ref": "distributed under the boost software license version 1 0",
    "epl-made:{v}": "this program and the accompanying materials are made available under the terms of the eclipse public license {v} which is available at https www eclipse org legal epl {v}",
    "epl-v10": "all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html",
    "cddl-subject": "the contents of this file are subject to the terms of the common development and distribution license the license",
    "mpl-subject:{v}": "the contents of this file are subject to the mozilla public license version {v} the license",
    "wtfpl-title": "do what the fuck you want to public license",
    "wtfpl-zero": "you just do what the fuck you want to",
    "beer": "as long as you retain this notice you can do whatever you want with this stuff",
    "postgres-grant": "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    "ncsa-redist": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers",
    "cc0-ref:{v}": "licensed under cc0 {v}",
    "rights-reserved": "all rights reserved",
    "ofl-text:{v}": "this font software is licensed under the sil open font license version {v}",
    "x11-name": "except as contained in this notice the name of the x consortium shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization from the x consortium",
    "hpnd-grant": "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation",
    "w3c-grant": "permission to copy modify and distribute this software and its documentation with or without modification for any purpose and without fee or royalty is hereby granted provided that you include the following on all copies of the software and documentation or portions thereof including modifications",
    "unicode-grant": "permission is hereby granted free of charge to any person obtaining a copy of data files and any associated documentation the data files or software and any associated documentation the software to deal in the data files or software without restriction including without limitation the rights to use copy modify merge publish distribute and or sell copies of the data files or software and to permit persons to whom the data files or software are furnished to do so provided that either",
    "openssl-product": "this product includes software developed by the openssl project for use in the openssl toolkit http www openssl org",
    "php-product": "this product includes php software freely available from http www php net software",
    "mspl-governs": "this license governs use of the accompanying software",
    "zpl-subject": "this software is subject to the provisions of the zope public license version 2 1 zpl",
    "eupl-ref:{v}": "licensed under the eupl version {v}",
    "psf-between": "this license agreement is between the python software foundation psf and the individual or organization licensee accessing and otherwise using this software python in source or binary form and its associated documentation",
    "vim-copies": "there are no restrictions on distributing unmodified copies of vim except that they must include this license text",
    "ruby-copies": "you may make and give away verbatim copies of the source form of the software without restriction provided that you duplicate all of the original copyright notices and associated disclaimers",
    "ijg-based": "this software is based in part on the work of the independent jpeg group",
    "afl-ref": "licensed under the academic free license version 3 0",
    "osl-ref": "licensed under the open software license version 3 0",
    "ecl-ref": "licensed under the educational community license version 2 0 the license you may not use this file except in compliance with the license",
    "sspl-free": "this program is free software you can redistribute it and or modify it under the terms of the server side public license version 1 as published by mongodb inc",
    "gfdl-free:{v}": "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version {v} or any later version published by the free software foundation",
    "mulan-ref": "this software is licensed under mulan psl v2",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    **{f"cc-{k}:{{v}}": f"licensed under cc {k.replace('-', ' ')} {{v}}" for k in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")},
}
#: Licences that sentences name: SPDX identifier and full name.  Fixed values.
NAMES: dict[str, str] = {
    "0BSD": "BSD Zero Clause License",
    "AFL-3.0": "Academic Free License v3.0",
    "AGPL-3.0-only": "GNU Affero General Public License v3.0 only",
    "AGPL-3.0-or-later": "GNU Affero General Public License v3.0 or later",
    "Apache-1.1": "Apache License 1.1",
    "Apache-2.0": "Apache License 2.0",
    "APSL-2.0": "Apple Public Source License 2.0",
    "Artistic-1.0": "Artistic License 1.0",
    "Artistic-2.0": "Artistic License 2.0",
    "Beerware": "Beerware License",
    "BlueOak-1.0.0": "Blue Oak Model License 1.0.0",
    "BSD-1-Clause": "BSD 1-Clause License",
    "BSD-2-Clause": "BSD 2-Clause License",
    "BSD-2-Clause-Patent": "BSD-2-Clause Plus Patent License",
    "BSD-3-Clause": "BSD 3-Clause License",
    "BSD-3-Clause-Clear": "BSD 3-Clause Clear License",
    "BSD-4-Clause": "BSD 4-Clause License",
    "BSL-1.0": "Boost Software License 1.0",
    "BUSL-1.1": "Business Source License 1.1",
    "CC-BY-3.0": "Creative Commons Attribution 3.0 Unported",
    "CC-BY-4.0": "Creative Commons Attribution 4.0 International",
    "CC-BY-NC-4.0": "Creative Commons Attribution Non Commercial 4.0 International",
    "CC-BY-NC-ND-4.0": "Creative Commons Attribution Non Commercial No Derivatives 4.0 International",
    "CC-BY-NC-SA-4.0": "Creative Commons Attribution Non Commercial Share Alike 4.0 International",
    "CC-BY-ND-4.0": "Creative Commons Attribution No Derivatives 4.0 International",
    "CC-BY-SA-3.0": "Creative Commons Attribution Share Alike 3.0 Unported",
    "CC-BY-SA-4.0": "Creative Commons Attribution Share Alike 4.0 International",
    "CC0-1.0": "Creative Commons Zero v1.0 Universal",
    "CDDL-1.0": "Common Development and Distribution License 1.0",
    "CDDL-1.1": "Common Development and Distribution License 1.1",
    "CECILL-2.1": "CeCILL Free Software License Agreement v2.1",
    "CPL-1.0": "Common Public License 1.0",
    "ECL-2.0": "Educational Community License v2.0",
    "EFL-2.0": "Eiffel Forum License v2.0",
    "Elastic-2.0": "Elastic License 2.0",
    "EPL-1.0": "Eclipse Public License 1.0",
    "EPL-2.0": "Eclipse Public License 2.0",
    "EUPL-1.1": "European Union Public License 1.1",
    "EUPL-1.2": "European Union Public License 1.2",
    "GFDL-1.2-or-later": "GNU Free Documentation License v1.2 or later",
    "GFDL-1.3-or-later": "GNU Free Documentation License v1.3 or later",
    "GPL-2.0-only": "GNU General Public License v2.0 only",
    "GPL-2.0-or-later": "GNU General Public License v2.0 or later",
    "GPL-3.0-only": "GNU General Public License v3.0 only",
    "GPL-3.0-or-later": "GNU General Public License v3.0 or later",
    "HPND": "Historical Permission Notice and Disclaimer",
    "IJG": "Independent JPEG Group License",
    "Intel": "Intel Open Source License",
    "IPL-1.0": "IBM Public License v1.0",
    "ISC": "ISC License",
    "LGPL-2.0-or-later": "GNU Library General Public License v2 or later",
    "LGPL-2.1-only": "GNU Lesser General Public License v2.1 only",
    "LGPL-2.1-or-later": "GNU Lesser General Public License v2.1 or later",
    "LGPL-3.0-only": "GNU Lesser General Public License v3.0 only",
    "LGPL-3.0-or-later": "GNU Lesser General Public License v3.0 or later",
    "LPPL-1.3c": "LaTeX Project Public License v1.3c",
    "MIT": "MIT License",
    "MIT-0": "MIT No Attribution",
    "MPL-1.1": "Mozilla Public License 1.1",
    "MPL-2.0": "Mozilla Public License 2.0",
    "MS-PL": "Microsoft Public License",
    "MS-RL": "Microsoft Reciprocal License",
    "MulanPSL-2.0": "Mulan Permissive Software License, Version 2",
    "NCSA": "University of Illinois/NCSA Open Source License",
    "ODbL-1.0": "Open Data Commons Open Database License v1.0",
    "OFL-1.1": "SIL Open Font License 1.1",
    "OpenSSL": "OpenSSL License",
    "OSL-3.0": "Open Software License 3.0",
    "PHP-3.01": "PHP License v3.01",
    "PostgreSQL": "PostgreSQL License",
    "PSF-2.0": "Python Software Foundation License 2.0",
    "QPL-1.0": "Q Public License 1.0",
    "Ruby": "Ruby License",
    "SISSL": "Sun Industry Standards Source License v1.1",
    "SSPL-1.0": "Server Side Public License, v 1",
    "Unicode-3.0": "Unicode License v3",
    "Unlicense": "The Unlicense",
    "UPL-1.0": "Universal Permissive License v1.0",
    "Vim": "Vim License",
    "W3C": "W3C Software Notice and License",
    "WTFPL": "Do What The F*ck You Want To Public License",
    "X11": "X11 License",
    "Zlib": "zlib License",
    "ZPL-2.1": "Zope Public License 2.1",
}
#: How a sentence names a licence; the first takes its identifier, the others its name.
NAMED_BY = ["spdx license identifier {}", "licensed under the {}", "this work is licensed under the {}", "this software is licensed under the {}", "released under the {}", "distributed under the {}", "distributed under the terms of the {}", "this project is licensed under the terms of the {}"]
#: Versions of each family, as the sentences and the licence names write them.  Fixed values.
VERSIONS: dict[str, list[str]] = {
    "apache": ["1.0", "1.1", "2.0"],
    "gpl": ["1", "2", "3", "2.0", "3.0"],
    "lgpl": ["2", "2.1", "3", "3.0"],
    "agpl": ["3", "3.0"],
    "mpl": ["1.1", "2.0"],
    "epl": ["1.0", "2.0"],
    "cc0": ["1.0"],
    "ofl": ["1.0", "1.1"],
    "eupl": ["1.1", "1.2"],
    "gfdl": ["1.1", "1.2", "1.3"],
    "cc": ["1.0", "2.0", "2.5", "3.0", "4.0"],
}
#: Ordered rules: licence, the identifiers that must follow one another, and one that
#: must not follow them.  The first that a document meets names its first licence.
RULES: list[tuple[str, list[str], str]] = [
    ("MIT", ["mit-grant", "mit-notice", "asis-software"], ""),
    ("MIT", ["mit-grant", "mit-notice"], ""),
    ("MIT-0", ["mit0-grant", "asis-software"], ""),
    ("MIT", ["mit-title"], ""),
    ("MIT", ["mit-title-paren"], ""),
    ("MIT", ["mit-ref"], ""),
    ("MIT", ["mit-licensed"], ""),
    ("Apache-{v}", ["apache-the:{v}", "apache-may"], ""),
    ("Apache-{v}", ["apache-ref:{v}"], ""),
    ("Apache-{v}", ["apache-the:{v}"], "apache-may"),
    ("AGPL-{v}-or-later", ["agpl-free:{v}"], ""),
    ("AGPL-{v}-only", ["agpl-work:{v}"], ""),
    ("LGPL-{v}-or-later", ["lgpl-free:{v}"], ""),
    ("LGPL-{v}-or-later", ["lgpl-program:{v}"], ""),
    ("LGPL-{v}-only", ["lgpl-work:{v}"], ""),
    ("GPL-{v}-or-later", ["gpl-free:{v}"], ""),
    ("GPL-{v}-only", ["gpl-work:{v}"], ""),
    ("GPL-{v}-only", ["gpl-licensed:{v}"], ""),
    ("MPL-{v}", ["mpl-form:{v}"], ""),
    ("MPL-{v}", ["mpl-subject:{v}"], ""),
    ("BSD-4-Clause", ["bsd-redist", "bsd-source", "bsd-binary", "bsd-advert"], ""),
    ("BSD-3-Clause", ["bsd-redist", "bsd-source", "bsd-binary", "bsd-names"], ""),
    ("BSD-3-Clause", ["bsd-redist", "bsd-source", "bsd-binary", "bsd-author"], ""),
    ("BSD-2-Clause", ["bsd-redist", "bsd-source", "bsd-binary", "bsd-asis"], ""),
    ("BSD-2-Clause", ["bsd-redist", "bsd-source", "bsd-binary"], "bsd-(names|author|advert|asis)"),
    ("BSD-1-Clause", ["bsd-redist", "bsd-source"], "bsd-binary"),
    ("ISC", ["isc-grant"], ""),
    ("0BSD", ["0bsd-grant"], ""),
    ("Zlib", ["zlib-asis", "zlib-liable", "zlib-grant"], ""),
    ("BSL-1.0", ["bsl-grant"], ""),
    ("BSL-1.0", ["bsl-ref"], ""),
    ("EPL-{v}", ["epl-made:{v}"], ""),
    ("EPL-1.0", ["epl-v10"], ""),
    ("CDDL-1.0", ["cddl-subject"], ""),
    ("WTFPL", ["wtfpl-title"], ""),
    ("WTFPL", ["wtfpl-zero"], ""),
    ("Beerware", ["beer"], ""),
    ("PostgreSQL", ["postgres-grant"], ""),
    ("NCSA", ["ncsa-redist"], ""),
    ("CC0-{v}", ["cc0-ref:{v}"], ""),
    ("Unlicense", ["unlicense-free"], ""),
    ("OFL-{v}", ["ofl-text:{v}"], ""),
    ("X11", ["mit-grant", "mit-notice", "x11-name"], ""),
    ("X11", ["x11-name"], ""),
    ("HPND", ["hpnd-grant"], ""),
    ("W3C", ["w3c-grant"], ""),
    ("Unicode-3.0", ["unicode-grant"], ""),
    ("OpenSSL", ["openssl-product"], ""),
    ("PHP-3.01", ["php-product"], ""),
    ("MS-PL", ["mspl-governs"], ""),
    ("ZPL-2.1", ["zpl-subject"], ""),
    ("EUPL-{v}", ["eupl-ref:{v}"], ""),
    ("PSF-2.0", ["psf-between"], ""),
    ("Vim", ["vim-copies"], ""),
    ("Ruby", ["ruby-copies"], ""),
    ("IJG", ["ijg-based"], ""),
    ("AFL-3.0", ["afl-ref"], ""),
    ("OSL-3.0", ["osl-ref"], ""),
    ("ECL-2.0", ["ecl-ref"], ""),
    ("SSPL-1.0", ["sspl-free"], ""),
    ("GFDL-{v}-or-later", ["gfdl-free:{v}"], ""),
    ("MulanPSL-2.0", ["mulan-ref"], ""),
    *((f"CC-{k.upper()}-{{v}}", [f"cc-{k}:{{v}}"], "") for k in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")),
    *((k, [f"named:{k}"], "") for k in NAMES),
    ("All-Rights-Reserved", ["rights-reserved"], ""),
]
#: Every known sentence holds one of these: single words, as any white space or punctuation may stand between two.
HINT = "licen|reserved|permission|warranty|warranties|redistribut|copyright|domain|compliance|liable|acknowledgement|gnu|eclipse|retain|restrictions|verbatim|includes|advertising|jpeg|distributed|released|what you want|endorse|fuck"


def versions_of(name: str) -> list[str]:
    return VERSIONS[name.lower().split(":")[0].split("-")[0]] if "{v}" in name else [""]


def plain(sentence: str) -> str:
    """A sentence as it is looked up: lower-case words and numbers, single spaces."""
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def sentence_table() -> dict[str, str]:
    """Normalised sentence -> identifier, versions and names filled in; a sentence of its own goes before a name."""
    named = {plain(form.format(spdx if k == 0 else name.removeprefix("The "))): f"named:{spdx}" for spdx, name in NAMES.items() for k, form in enumerate(NAMED_BY)}
    return named | {s.format(v=v.replace(".", " ")): k.format(v=v) for k, s in SENTENCES.items() for v in versions_of(k)}


def rule_table() -> list[tuple[str, list[str], str]]:
    """Licence, its identifiers and what mustn't follow, versions filled in."""
    return [(n.format(v=v if "." in v else f"{v}.0"), [x.format(v=v) for x in rule], but) for n, rule, but in RULES for v in versions_of(n)]


def expression_table() -> dict[str, str]:
    """What stands for a licence in an SPDX expression, normalised -> its identifier; old forms (``GPL-2.0``, ``GPL-2.0+``) as their new ones."""
    old = {k.removesuffix("-only") + sign: k.removesuffix("-only") + end for k in NAMES if k.endswith("-only") for sign, end in (("", "-only"), ("+", "-or-later"))}
    return {expression_key(k): f"named:{v}" for k, v in (old | {n: n for n in NAMES}).items() if v in NAMES}


def expression_key(name: str) -> str:
    return name.lower()


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def _identifiers(parts: Column) -> Column:
    table = sentence_table()
    # A set of all sentences is asked first, as a map is searched from its start.
    known = F.filter(F.transform(parts, normalised), lambda s: s.isin(*table))
    return F.filter(F.transform(known, lambda s: _lookup(table, s)), lambda x: x.isNotNull())


#: A tag up to its line's end, and what parts its expression into licences; an exception belongs to the licence before it.
TAG = r"(?i)SPDX-License-Identifier:[ \t]*([^\r\n]*)"
OPERATORS, EXCEPTION = r"[ \t]+(?:OR|AND|or|and)[ \t]+|[()]+", r"[ \t]+(?:WITH|with)[ \t]+[A-Za-z0-9.-]+"


def _expressions(text: Column) -> Column:
    """Identifiers of the licences in the SPDX expressions of a text; a tag with one licence alone is a sentence already."""
    tags = F.filter(F.regexp_extract_all(text, F.lit(TAG), F.lit(1)), lambda t: t.rlike(rf"{OPERATORS}|{EXCEPTION}|\+"))
    parts = F.flatten(F.transform(tags, lambda t: F.split(F.regexp_replace(t, EXCEPTION, ""), OPERATORS)))
    names = F.transform(parts, lambda p: F.lower(F.regexp_extract(p, r"^[ \t]*([A-Za-z0-9.+-]+)", 1)))
    return F.filter(F.transform(names, lambda n: _lookup(expression_table(), n)), lambda x: x.isNotNull())


def _ranks(ids: Column) -> Column:
    """The places of the rules that a list of identifiers meets."""
    rules = list(enumerate(rule_table()))
    single = {rule[0]: k for k, (_, rule, but) in reversed(rules) if len(rule) == 1 and not but}
    alone = F.filter(F.transform(ids, lambda i: _lookup(single, i)), lambda x: x.isNotNull())
    joined = F.concat(F.lit("|"), F.array_join(ids, "|"), F.lit("|"))
    runs = [F.when(joined.rlike(rf"\|{r'\|'.join(map(re.escape, rule))}\|" + (rf"(?!{but}\|)" if but else "")), F.lit(k)) for k, (_, rule, but) in rules if len(rule) > 1 or but]
    return F.concat(alone, F.filter(F.array(*runs), lambda x: x.isNotNull()))


def scan(docs: DataFrame) -> DataFrame:
    """``docs``' ``doc_id`` with what is recognised in its text.

    ``sentence_ids``: identifiers in order, joined by ``|`` (empty if none);
    ``licenses``: the licences of all rules met, in the rules' order, each once,
    joined by ``,``; ``first_license``: the first of them, null if none.  Identifiers of an
    SPDX expression's licences come after those of the sentences.
    Sentences end at ``.``, ``!``, ``?`` or ``;`` before white space, and at line
    ends; where a licence is wrapped over lines, the same is tried with line ends
    as white space.  A null or empty text has none; rows repeat as given, null
    ids too; an empty table gives no rows; other columns are ignored.
    """
    # The point of "v. 2.0" ends no sentence.
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"\b([vV])\.[ \t\r\n\f]+([0-9])", "$1 $2")
    cut = F.regexp_replace(text, "([.!?;])[ \\t\\r\\n\\f]+", "$1\n")
    lines = _identifiers(F.split(cut, "[\\r\\n]+"))
    wrapped = F.regexp_replace(F.regexp_replace(text, "[ \\t\\r\\n\\f]+", " "), "([.!?;:]) ", "$1\n")
    unwrapped = _identifiers(F.split(wrapped, "\n"))
    none = F.array().cast("array<string>")
    # Plain searches of the text as it is; only what passes is cut and replaced in.
    maybe = F.lit(False)
    for word in HINT.split("|"):
        maybe = maybe | F.col("__low").contains(word)
    tagged = F.when(text.rlike("(?i)SPDX-License-Identifier:"), _expressions(text)).otherwise(none)
    found = docs.select("doc_id", "text", F.lower(F.coalesce("text", F.lit(""))).alias("__low")).select("doc_id", F.when(maybe, lines).otherwise(none).alias("a"), F.when(maybe, unwrapped).otherwise(none).alias("b"), F.when(maybe, tagged).otherwise(none).alias("c"))
    # Licences of expressions come after the sentences.
    ids = found.select("doc_id", *(F.concat(x, "c").alias(x) for x in "ab"))
    some = (F.size("a") > 0) | (F.size("b") > 0)
    names = F.array(*(F.lit(n) for n, _, _ in rule_table()))
    met = F.array_sort(F.array_distinct(F.concat(_ranks(F.col("a")), _ranks(F.col("b")))))
    licenses = F.when(some, F.array_distinct(F.transform(met, lambda k: F.get(names, k)))).otherwise(none)
    longer = F.when(F.size("b") > F.size("a"), F.col("b")).otherwise(F.col("a"))
    return ids.select("doc_id", F.array_join(longer, "|").alias("sentence_ids"), licenses.alias("l")).select(
        "doc_id", "sentence_ids", F.array_join("l", ",").alias("licenses"), F.try_element_at("l", F.lit(1)).alias("first_license")
    )


def sql() -> str:
    """DuckDB SQL for ``scan`` of ``documents``: sentences as rows, joined with the sentences' and the rules' tables."""
    sentences = ", ".join(f"('{s}', '{i}')" for s, i in sentence_table().items())
    tags = ", ".join(f"('{s}', '{i}')" for s, i in expression_table().items())
    rules = ", ".join(f"({k}, '{n}', {len(r)}, [{', '.join(repr(x) for x in r)}], '{but}')" for k, (n, r, but) in enumerate(rule_table()))
    return rf"""
WITH known(sentence, id) AS (VALUES {sentences}),
rules(rank, name, n, ids, but) AS (VALUES {rules}),
d AS (SELECT row_number() OVER () AS k, doc_id, regexp_replace(coalesce(text, ''), '\b([vV])\.[ \t\r\n\f]+([0-9])', '\1 \2', 'g') AS text FROM documents),
forms AS (
  SELECT k, 0 AS form, string_split_regex(regexp_replace(text, '([.!?;])[ 	
]+', '' || chr(10), 'g'), '[
]+') AS parts FROM d
  UNION ALL
  SELECT k, 1, string_split(regexp_replace(regexp_replace(text, '[ 	
]+', ' ', 'g'), '([.!?;:]) ', '' || chr(10), 'g'), chr(10)) FROM d),
parts AS (SELECT k, form, unnest(parts) AS part, generate_subscripts(parts, 1) AS place FROM forms),
tags(name, id) AS (VALUES {tags}),
tagged AS (SELECT k, unnest(regexp_extract_all(text, '(?i)SPDX-License-Identifier:[ \t]*([^\r\n]*)', 1)) AS tag, generate_subscripts(regexp_extract_all(text, '(?i)SPDX-License-Identifier:[ \t]*([^\r\n]*)', 1), 1) AS t FROM d),
operands AS (SELECT k, t, unnest(o) AS operand, generate_subscripts(o, 1) AS n FROM (SELECT k, t, string_split_regex(regexp_replace(tag, '[ \t]+(WITH|with)[ \t]+[A-Za-z0-9.-]+', '', 'g'), '[ \t]+(OR|AND|or|and)[ \t]+|[()]+') AS o FROM tagged WHERE regexp_matches(tag, '[ \t]+(OR|AND|or|and)[ \t]+|[()]+|[ \t]+(WITH|with)[ \t]+[A-Za-z0-9.-]+|[+]'))),
met AS (
  SELECT k, form, place, id FROM parts JOIN known ON trim(regexp_replace(lower(part), '[^a-z0-9]+', ' ', 'g')) = sentence
  UNION ALL
  SELECT k, unnest([0, 1]), 1000000000 + 1000000 * t + n, id FROM operands JOIN tags ON lower(regexp_extract(operand, '^[ \t]*([A-Za-z0-9.+-]+)', 1)) = name),
found AS (SELECT k, form, list(id ORDER BY place) AS ids FROM met GROUP BY k, form),
starts AS (SELECT k, ids, unnest(range(1, len(ids) + 1)) AS "at" FROM found),
names AS (
  SELECT DISTINCT ON (k, name) k, name, rank FROM starts JOIN rules ON list_slice(starts.ids, starts."at", starts."at" + n - 1) = rules.ids
    AND (but = '' OR starts."at" + n > len(starts.ids) OR NOT regexp_full_match(starts.ids[starts."at" + n], but))
  ORDER BY k, name, rank),
licences AS (SELECT k, list(name ORDER BY rank) AS l FROM names GROUP BY k)
SELECT d.doc_id, coalesce(array_to_string(CASE WHEN len(coalesce(b.ids, [])) > len(coalesce(a.ids, [])) THEN b.ids ELSE a.ids END, '|'), '') AS sentence_ids,
       coalesce(array_to_string(l, ','), '') AS licenses, l[1] AS first_license
FROM d LEFT JOIN found a ON a.k = d.k AND a.form = 0 LEFT JOIN found b ON b.k = d.k AND b.form = 1 LEFT JOIN licences ON licences.k = d.k"""
