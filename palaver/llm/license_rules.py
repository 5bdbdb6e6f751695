"""Signature rules of the license scan, over texts reduced to words and single spaces.

A rule has a label, a keyword that every match of its pattern contains, a
pattern, a priority and a weight. Patterns are written by hand, once for each
name a license goes by; the forms below make the rules of each name:

* ``id``    an SPDX tag with the license's identifier   (priority 4)
* ``grant`` a verb of granting before the name          (priority 3)
* ``name``  the name by itself                          (priority 2)
* ``notice`` wording of license texts and notices       (priority 1)
* ``base``  the asked phrases; never suppressed          (priority 0)
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    name: str
    label: str
    keyword: str
    pattern: str
    priority: int
    weight: float
    base: bool = False


BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

GRANT = (r"(?:re|dual |jointly |is |are )?(?:licen[cs]ed|released|distributed|published|available|provided|offered"
         r"|shared|covered|governed|used)(?: to you)? (?:under|by|with|using|subject to|in accordance with)"
         r"(?: (?:the|a|an))?(?: terms(?: and conditions)? of(?: the)?)?(?: \S+){0,2}? ")
VERSION = r"(?: (?:version|ver|v))?"
LICENCE = r"(?: public)?(?: software)?(?: licen[cs]e)?"

# label, keyword, identifier (as words; None: no tag), name
NAMES = [
    ("mit", "mit licen", None, r"(?:the )?(?:expat )?mit licen[cs]e"),
    ("mit-0", "mit no attribution", "mit 0", r"mit no attribution(?: licen[cs]e)?"),
    ("mit-x11", "x11 licen", "x11", r"(?:mit )?x11 licen[cs]e"),
    ("isc", "isc licen", "isc", r"isc licen[cs]e"),
    ("zlib", "zlib", "zlib", r"zlib(?: libpng)? licen[cs]e"),
    ("libpng", "libpng", "libpng(?: 2 0)?", r"libpng licen[cs]e" + VERSION + r"(?: 2)?"),
    ("bsl-1.0", "boost software", "bsl 1 0", r"boost software licen[cs]e" + VERSION + r"(?: 1 0)?"),
    ("ncsa", "ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[cs]e"),
    ("unlicense", "unlicen", "unlicense", r"unlicen[cs]e"),
    ("wtfpl", "wtfpl", "wtfpl", r"wtfpl" + VERSION + r"(?: 2)?"),
    ("0bsd", "0bsd", "0bsd", r"0bsd(?: licen[cs]e)?"),
    ("postgresql", "postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("python-2.0", "python", "python 2 0", r"python (?:software foundation )?licen[cs]e" + VERSION + r"(?: 2(?: 0)?)?"),
    ("psf-2.0", "psf", "psf 2 0", r"psf licen[cs]e" + VERSION + r"(?: 2(?: 0)?)?"),
    ("php-3.01", "php licen", "php 3 01", r"php licen[cs]e" + VERSION + r"(?: 3 0?1)?"),
    ("ruby", "ruby licen", "ruby", r"ruby licen[cs]e"),
    ("openssl", "openssl", "openssl", r"openssl licen[cs]e"),
    ("curl", "curl licen", "curl", r"curl licen[cs]e"),
    ("vim", "vim licen", "vim", r"vim licen[cs]e"),
    ("beerware", "beer", "beerware", r"beer ?ware(?: licen[cs]e)?"),
    ("json", "json licen", "json", r"json licen[cs]e"),
    ("afl-3.0", "academic free", "afl 3 0", r"academic free licen[cs]e" + VERSION + r"(?: 3 0)?"),
    ("osl-3.0", "open software licen", "osl 3 0", r"open software licen[cs]e" + VERSION + r"(?: 3 0)?"),
    ("ms-pl", "microsoft public", "ms pl", r"microsoft public licen[cs]e"),
    ("ms-rl", "microsoft reciprocal", "ms rl", r"microsoft reciprocal licen[cs]e"),
    ("ipl-1.0", "ibm public", "ipl 1 0", r"ibm public licen[cs]e" + VERSION + r"(?: 1 0)?"),
    ("cpl-1.0", "common public licen", "cpl 1 0", r"common public licen[cs]e" + VERSION + r"(?: 1 0)?"),
    ("cpal-1.0", "common public attribution", "cpal 1 0", r"common public attribution licen[cs]e" + VERSION + r"(?: 1 0)?"),
    ("qpl-1.0", "q public", "qpl 1 0", r"q public licen[cs]e" + VERSION + r"(?: 1 0)?"),
    ("sleepycat", "sleepycat", "sleepycat", r"sleepycat licen[cs]e"),
    ("zpl-2.1", "zope", "zpl 2 1", r"zope public licen[cs]e" + VERSION + r"(?: 2 1)?"),
    ("w3c", "w3c", "w3c", r"w3c (?:software (?:notice )?)?(?:and )?(?:document )?licen[cs]e"),
    ("unicode", "unicode licen", "unicode (?:dfs 2016|tou|3 0)", r"unicode licen[cs]e(?: agreement)?"),
    ("ofl-1.1", "open font", "ofl 1 1", r"(?:sil )?open font licen[cs]e" + VERSION + r"(?: 1 [01])?"),
    ("gfdl", "free documentation", "gfdl 1 [123](?: only| or later)?", r"(?:gnu )?free documentation licen[cs]e" + VERSION
     + r"(?: 1 [123])?"),
    ("odbl-1.0", "open database", "odbl 1 0", r"open database licen[cs]e" + VERSION + r"(?: 1 0)?"),
    ("odc-by-1.0", "open data commons", "odc by 1 0", r"open data commons attribution(?: licen[cs]e)?" + VERSION + r"(?: 1 0)?"),
    ("pddl-1.0", "public domain dedication", "pddl 1 0", r"public domain dedication and licen[cs]e" + VERSION + r"(?: 1 0)?"),
    ("cc0-1.0", "cc0", "cc0 1 0", r"(?:creative commons )?cc0" + VERSION + r"(?: 1 0)?(?: universal)?"),
    ("cc-zero", "commons zero", None, r"creative commons zero" + VERSION + r"(?: 1 0)?(?: universal)?"),
    ("cc-pdm", "public domain mark", None, r"public domain mark" + VERSION + r"(?: 1 0)?"),
    ("artistic-1.0", "artistic", "artistic 1 0", r"artistic licen[cs]e" + VERSION + r"(?: 1 0)?"),
    ("artistic-2.0", "artistic", "artistic 2 0", r"artistic licen[cs]e" + VERSION + r" 2(?: 0)?"),
    ("sspl-1.0", "server side public", "sspl 1 0", r"server side public licen[cs]e" + VERSION + r"(?: 1 0)?"),
    ("busl-1.1", "business source", "busl 1 1", r"business source licen[cs]e" + VERSION + r"(?: 1 1)?"),
    ("elastic-2.0", "elastic licen", "elastic 2 0", r"elastic licen[cs]e" + VERSION + r"(?: 2 0)?"),
    ("commons-clause", "commons clause", None, r"commons clause(?: licen[cs]e)?(?: condition)?"),
    ("polyform-nc", "polyform noncommercial", "polyform noncommercial 1 0 0", r"polyform noncommercial(?: licen[cs]e)?"),
    ("ecl-2.0", "educational community", "ecl 2 0", r"educational community licen[cs]e" + VERSION + r"(?: 2 0)?"),
    ("upl-1.0", "universal permissive", "upl 1 0", r"universal permissive licen[cs]e" + VERSION + r"(?: 1 0)?"),
    ("mulan-psl", "mulan", "mulanpsl [12] 0", r"mulan permissive software licen[cs]e" + VERSION + r"(?: [12](?: 0)?)?"),
    ("cern-ohl", "open hardware", "cern ohl(?: [pws])? [12] [02]", r"cern open hardware licen[cs]e" + VERSION + r"(?: [12](?: [02])?)?"),
    ("openrail", "openrail", None, r"(?:creativeml |bigscience |bigcode )?openrail(?: [ms])?(?: licen[cs]e)?"),
    ("crown-ogl", "open government", "ogl uk [123] 0", r"open government licen[cs]e" + VERSION + r"(?: [123](?: 0)?)?"),
    ("etalab-2.0", "licence ouverte", "etalab 2 0", r"licence ouverte(?: open licen[cs]e)?" + VERSION + r"(?: 2 0)?"),
    ("dl-de-by-2.0", "datenlizenz deutschland", "dl de by 2 0", r"datenlizenz deutschland(?: namensnennung)?" + VERSION
     + r"(?: 2 0)?"),
]

# label, keyword, name, versions: a rule for the name with each version, and one without
VERSIONED = [
    ("apache", "apache", r"apache(?: software)? licen[cs]e", "1.0 1.1 2.0"),
    ("apache-short", "apache", r"apache", "1.0 1.1 2.0"),
    ("gpl", "general public licen[cs]e", r"(?:gnu )?general public licen[cs]e", "1.0 2.0 3.0"),
    ("gpl", "gpl", r"(?:gnu )?gpl", "1.0 2.0 3.0"),
    ("lgpl", "lesser general public", r"(?:gnu )?lesser general public licen[cs]e", "2.1 3.0"),
    ("lgpl", "library general public", r"(?:gnu )?library general public licen[cs]e", "2.0"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", "2.0 2.1 3.0"),
    ("agpl", "affero general public", r"(?:gnu )?affero general public licen[cs]e", "1.0 3.0"),
    ("agpl", "agpl", r"(?:gnu )?agpl", "1.0 3.0"),
    ("mpl", "mozilla public", r"mozilla public licen[cs]e", "1.0 1.1 2.0"),
    ("mpl", "mpl", r"mpl", "1.0 1.1 2.0"),
    ("epl", "eclipse public", r"eclipse public licen[cs]e", "1.0 2.0"),
    ("edl", "eclipse distribution", r"eclipse distribution licen[cs]e", "1.0"),
    ("cddl", "common development", r"common development and distribution licen[cs]e", "1.0 1.1"),
    ("cddl", "cddl", r"cddl", "1.0 1.1"),
    ("eupl", "european union public", r"european union public licen[cs]e", "1.0 1.1 1.2"),
    ("eupl", "eupl", r"eupl", "1.0 1.1 1.2"),
    ("apsl", "apple public", r"apple public source licen[cs]e", "1.0 2.0"),
    ("lppl", "latex project", r"latex project public licen[cs]e", "1.0 1.2 1.3"),
    ("cecill", "cecill", r"cecill", "1.0 2.0 2.1"),
]

# elements of Creative Commons licenses: short words, long words
CREATIVE_COMMONS = {
    "by": ("by", "attribution"),
    "by-sa": ("by sa", r"attribution share ?alike"),
    "by-nc": ("by nc", r"attribution non ?commercial"),
    "by-nd": ("by nd", r"attribution no ?deriv(?:ative)?s?"),
    "by-nc-sa": ("by nc sa", r"attribution non ?commercial share ?alike"),
    "by-nc-nd": ("by nc nd", r"attribution non ?commercial no ?deriv(?:ative)?s?"),
}
CC_VERSIONS = "1.0 2.0 2.5 3.0 4.0"

BSD = {"1": "one|1", "2": "two|2|simplified|freebsd", "3": "three|3|new|modified|revised", "4": "four|4|original|old"}

# label, keyword, wording
NOTICES = [
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "substantial portions", r"shall be included in all copies or substantial portions of the software"),
    ("isc", "permission to use copy", r"permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification"
     r"(?: are permitted)?"),
    ("bsd-3-clause", "endorse or promote", r"(?:may|nor) (?:not )?be used to endorse or promote products derived from"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software"),
    ("gpl", "free software", r"(?:this|it) (?:program |library )?is free software you can redistribute it and or modify it"),
    ("gpl-or-later", "any later version", r"either version \d(?: \d)? (?:of the licen[cs]e )?or at your option any later version"),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such"),
    ("unlicense", "released into the public domain", r"free and unencumbered software released into the public domain"),
    ("wtfpl", "do what the", r"do what the \S+ you want to(?: public licen[cs]e)?"),
    ("public-domain", "public domain", r"(?:released|placed|dedicated|belongs|is)(?: \S+){0,3}? (?:in|into|to) the public domain"),
    ("public-domain", "gemeinfrei", r"gemeinfrei(?:es|er|e)?"),
    ("public-domain", "domaine public", r"(?:dans|du) (?:le )?domaine public"),
    ("no-rights", "no rights reserved", r"no rights reserved"),
    ("some-rights", "some rights reserved", r"some rights reserved"),
    ("proprietary", "proprietary", r"(?:confidential and )?proprietary(?: and confidential)?(?: information| software| licen[cs]e)?"),
    ("proprietary", "trade secret", r"(?:contains|constitutes|are) (?:\S+ )?trade secrets?"),
    ("non-commercial", "commercial use", r"(?:non|not for|no|without) commercial use(?: only)?"),
    ("non-commercial", "noncommercial", r"(?:for )?noncommercial (?:use|purposes)(?: only)?"),
    ("research-only", "research purposes", r"(?:for )?(?:academic |educational )?(?:and )?research purposes only"),
    ("research-only", "educational use", r"for educational use only"),
    ("evaluation-only", "evaluation", r"for evaluation (?:purposes )?only"),
    ("no-redistribution", "redistribut", r"(?:may|must|shall) not be (?:copied |reproduced )?(?:or )?redistributed"),
    ("no-reproduction", "reproduc", r"(?:may|must|shall) not be reproduced(?: or (?:used|distributed|transmitted))?"),
    ("no-reproduction", "without permission", r"(?:reproduction|copying|use) without (?:written )?permission is prohibited"),
    ("no-reproduction", "no part of this", r"no part of this (?:publication|work|book|document) may be reproduced"),
    ("no-training", "text and data mining", r"(?:text and data mining|tdm) (?:is |are )?(?:reserved|prohibited|not permitted)"),
    ("eula", "end user licen", r"end user licen[cs]e agreement"),
    ("reserved", "tous droits", r"tous droits r(?:é|e)serv(?:é|e)s"),
    ("reserved", "alle rechte", r"alle rechte vorbehalten"),
    ("reserved", "todos los derechos", r"todos los derechos reservados"),
    ("reserved", "tutti i diritti", r"tutti i diritti riservati"),
    ("copyright", "copyright", r"copyright(?: c| ©| by)?(?: \d{4}(?: \d{4})?)?(?: by)?"),
    ("copyright", "©", r"© ?\d{4}(?: \d{4})?"),
    ("license-mention", "licen", r"(?:see|read|accept|agree to) (?:the )?(?:accompanying )?licen[cs]e(?: file| agreement| terms)?"),
    ("license-mention", "licen", r"licen[cs]e file"),
    ("as-is", "as is", r"provided as is without (?:any )?(?:express or implied )?warrant(?:y|ies)"),
    ("as-is", "without warrant", r"without warrant(?:y|ies) (?:or conditions )?of any kind"),
]


def _version(v: str) -> str:
    return v.replace(".", " ")


def _forms(label: str, keyword: str, tag: str | None, name: str) -> list[Rule]:
    out = [Rule(f"grant:{label}", label, keyword, GRANT + name, 3, 0.95),
           Rule(f"name:{label}", label, keyword, name, 2, 0.8)]
    if tag:
        out.append(Rule(f"id:{label}", label, "spdx licen",
                        rf"spdx licen[cs]e identifier (?:\S+ ){{0,3}}?{tag}", 4, 0.99))
    return out


def rules() -> list[Rule]:
    """All rules in order; of two alike in priority and length the earlier one wins."""
    out = [Rule(f"base:{label}", label, phrase, phrase, 0, 0.5, True) for phrase, label in BASE.items()]
    for label, keyword, tag, name in NAMES:
        out += _forms(label, keyword, tag, name)
    out.append(Rule("id:mit", "mit", "spdx licen", r"spdx licen[cs]e identifier (?:\S+ ){0,3}?mit", 4, 0.99))
    for label, keyword, name, versions in VERSIONED:
        family = label.removesuffix("-short")
        literal = keyword.split("[")[0]
        for v in versions.split():
            number = _version(v).replace(" 0", "(?: 0)?")
            joined = rf"{VERSION} ?v?{number}"  # as one word, too: gplv3
            full = f"{family}-{v}"
            out += _forms(full, literal, f"{family} {_version(v)}(?: only)?", name + joined)
            out.append(Rule(f"later:{full}", f"{full}-or-later", literal,
                            name + joined + r" or (?:at your option )?(?:any )?later(?: versions?)?", 3, 0.95))
        if label == family:
            out += _forms(family, literal, None, name)
    for clauses, words in BSD.items():
        label = f"bsd-{clauses}-clause"
        out += _forms(label, "bsd", f"bsd {clauses} clause", rf"(?:(?:{words})(?: clause)? bsd|bsd (?:{words}) clause)(?: licen[cs]e)?")
    out += _forms("bsd", "bsd", None, r"bsd(?: style)? licen[cs]e")
    for element, (short, long) in CREATIVE_COMMONS.items():
        for v in [None, *CC_VERSIONS.split()]:
            label = f"cc-{element}" + (f"-{v}" if v else "")
            tail = rf"{VERSION} {_version(v)}" if v else ""
            port = r"(?: (?:international|unported|generic|deed))?" if v else ""
            out += _forms(label, f"cc {short}", f"cc {short} {_version(v)}" if v else None, f"cc {short}{LICENCE}{tail}{port}")
            out += _forms(label, "creative commons", None, f"creative commons {long}{LICENCE}{tail}{port}")
    out += [Rule(f"notice:{label}", label, keyword, wording, 1, 0.7 if label not in ("copyright", "license-mention") else 0.3)
            for label, keyword, wording in NOTICES]
    numbered, patterns = [], {}
    for r in out:  # names that share an identifier share its rule
        own = patterns.setdefault(r.name, [])
        if r.pattern not in own:
            own.append(r.pattern)
            numbered.append(r._replace(name=f"{r.name}/{len(own)}"))
    return numbered
