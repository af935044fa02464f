"""The signature rules: a table of licences, and the wordings in which they are named.

Patterns are matched against words in lower case between single spaces ("version 2.0" is
"version 2 0").  Every licence has its names and, where they exist, its identifier in tags, its
address and its notice; the wordings around a name are the same for all licences, so the rules
are their product.
"""

from __future__ import annotations

from typing import NamedTuple


class Licence(NamedTuple):
    """``keywords``, between bars: one is in every name."""

    label: str
    keywords: str
    names: str
    tags: tuple[str, ...] = ()
    addresses: tuple[str, ...] = ()


class Rule(NamedTuple):
    """``priority`` 1 is the most certain.  One of ``keywords`` and ``also`` must occur, each at the
    beginning of a word, for the pattern to be tried: they are in all that it matches."""

    priority: int
    label: str
    keywords: tuple[str, ...]
    also: str
    pattern: str


# names, identifiers and addresses of public licences: fixed values
LICENCES = [
    Licence("agpl", "affero|agpl", "(gnu )?affero (general public|gpl)|agpl(v?3)?", ("agpl 3 0( only| or later)?",), ("gnu org licenses agpl",)),
    Licence("apache", "apache|asl", "apache( software)?( 2( 0)?)?|asl( 2( 0)?)?", ("apache 2 0", "apache 1 1", "apache 1 0"), ("apache org licenses",)),
    Licence("artistic", "artistic", "(perl )?artistic( 2( 0)?)?", ("artistic 2 0", "artistic 1 0"), ("opensource org licenses artistic",)),
    Licence("boost", "boost|bsl", "boost( software)?|bsl 1 0", ("bsl 1 0",), ("boost org license 1 0",)),
    Licence("bsd", "bsd", "(new |modified |simplified |revised |original )?bsd( [234] clause)?|[234] clause bsd", ("bsd [234] clause", "0bsd"), ("opensource org licenses bsd",)),
    Licence("cc0", "cc0|creative commons", "cc0( 1 0)?|creative commons zero", ("cc0 1 0",), ("creativecommons org publicdomain zero",)),
    Licence("cc-by", "cc by|creative commons", "cc by( [1-4] [05])?|creative commons attribution( [1-4] [05])?( international| unported)?", ("cc by [1-4] [05]",), ("creativecommons org licenses by [1-4]",)),
    Licence("cc-by-nc", "cc by|creative commons", "cc by nc( [1-4] [05])?|creative commons attribution non ?commercial( [1-4] [05])?", ("cc by nc [1-4] [05]",), ("creativecommons org licenses by nc [1-4]",)),
    Licence("cc-by-nc-nd", "cc by|creative commons", "cc by nc nd( [1-4] [05])?|creative commons attribution non ?commercial no ?deriv(ative)?s( [1-4] [05])?", ("cc by nc nd [1-4] [05]",), ("creativecommons org licenses by nc nd",)),
    Licence("cc-by-nc-sa", "cc by|creative commons", "cc by nc sa( [1-4] [05])?|creative commons attribution non ?commercial share ?alike( [1-4] [05])?", ("cc by nc sa [1-4] [05]",), ("creativecommons org licenses by nc sa",)),
    Licence("cc-by-nd", "cc by|creative commons", "cc by nd( [1-4] [05])?|creative commons attribution no ?deriv(ative)?s( [1-4] [05])?", ("cc by nd [1-4] [05]",), ("creativecommons org licenses by nd",)),
    Licence("cc-by-sa", "cc by|creative commons", "cc by sa( [1-4] [05])?|creative commons attribution share ?alike( [1-4] [05])?", ("cc by sa [1-4] [05]",), ("creativecommons org licenses by sa",)),
    Licence("cddl", "cddl|common development", "cddl( 1 [01])?|common development and distribution", ("cddl 1 [01]",), ("opensource org licenses cddl",)),
    Licence("cecill", "cecill", "cecill( [abc])?( 2 [01])?", ("cecill [abc]", "cecill 2 [01]"), ("cecill info",)),
    Licence("cpal", "cpal|common public", "cpal( 1 0)?|common public attribution", ("cpal 1 0",), ("opensource org licenses cpal",)),
    Licence("cpl", "cpl|common public", "cpl( 1 0)?|common public", ("cpl 1 0",), ("opensource org licenses cpl",)),
    Licence("ecl", "ecl|educational community", "ecl( 2 0)?|educational community", ("ecl 2 0",), ("opensource org licenses ecl",)),
    Licence("epl", "epl|eclipse public", "epl( [12] 0)?|eclipse public", ("epl [12] 0",), ("eclipse org legal epl",)),
    Licence("eupl", "eupl|european union", "eupl( 1 [12])?|european union public", ("eupl 1 [12]",), ("joinup ec europa eu",)),
    Licence("fdl", "fdl|gfdl|gnu free", "(gnu )?(gfdl|fdl)( 1 [123])?|gnu free documentation", ("gfdl 1 [123]( only| or later)?",), ("gnu org (licenses|copyleft) fdl",)),
    Licence("gpl", "gpl", "gnu gpl( ?v?[123]( 0)?)?|gpl( ?v?[123]( 0)?)?", ("gpl [123] 0( only| or later)?",), ("gnu org (licenses|copyleft) gpl",)),
    Licence("gpl", "general public", "(gnu )?general public", (), ("gnu org (licenses|copyleft) old licenses gpl",)),
    Licence("isc", "isc", "isc", ("isc",), ("opensource org licenses isc",)),
    Licence("lgpl", "lgpl", "(gnu )?lgpl( ?v?[23]( [01])?)?", ("lgpl [23] [01]( only| or later)?",), ("gnu org (licenses|copyleft) lgpl",)),
    Licence("lgpl", "general public", "(gnu )?(lesser|library) general public", (), ("gnu org (licenses|copyleft) lesser",)),
    Licence("lppl", "lppl|latex project", "lppl( 1 3[ac]?)?|latex project public", ("lppl 1 3[ac]",), ("latex project org lppl",)),
    Licence("mit", "mit|expat", "mit( expat| x11)?|expat", ("mit( 0)?",), ("opensource org licenses mit",)),
    Licence("mpl", "mpl", "mpl( ?v?[12] [01])?", ("mpl [12] [01]",), ("mozilla org mpl",)),
    Licence("mpl", "mozilla", "mozilla public", (), ("mozilla org en us mpl",)),
    Licence("ms-pl", "microsoft", "microsoft public", ("ms pl",), ("opensource org licenses ms pl",)),
    Licence("ms-rl", "microsoft", "microsoft reciprocal", ("ms rl",), ("opensource org licenses ms rl",)),
    Licence("ncsa", "ncsa", "(university of illinois )?ncsa( open source)?", ("ncsa",), ("opensource org licenses ncsa",)),
    Licence("odbl", "odbl|open database", "odbl( 1 0)?|open database", ("odbl 1 0",), ("opendatacommons org licenses odbl",)),
    Licence("ofl", "ofl|open font", "(sil )?ofl( 1 1)?|sil open font|open font", ("ofl 1 [01]",), ("scripts sil org ofl",)),
    Licence("openssl", "openssl", "openssl", ("openssl",), ("openssl org source license",)),
    Licence("osl", "osl|open software", "osl( 3 0)?|open software", ("osl [123] [01]",), ("opensource org licenses osl",)),
    Licence("php", "php", "php( 3 01?)?", ("php 3 01?",), ("php net license",)),
    Licence("postgresql", "postgresql", "postgresql", ("postgresql",), ("opensource org licenses postgresql",)),
    Licence("public-domain", "public domain", "public domain", ("pddl 1 0",), ("creativecommons org publicdomain mark",)),
    Licence("python", "python|psf", "python( software foundation)?|psf", ("psf 2 0", "python 2 0"), ("python org psf license",)),
    Licence("ruby", "ruby", "ruby", ("ruby",), ("ruby lang org en about license",)),
    Licence("unlicense", "unlicense", "unlicense", ("unlicense",), ("unlicense org",)),
    Licence("upl", "upl|universal permissive", "upl( 1 0)?|universal permissive", ("upl 1 0",), ("opensource org licenses upl",)),
    Licence("w3c", "w3c", "w3c( software( notice and)?)?", ("w3c",), ("w3 org consortium legal",)),
    Licence("wtfpl", "wtfpl", "wtfpl", ("wtfpl",), ("wtfpl net",)),
    Licence("zlib", "zlib", "zlib( libpng)?", ("zlib",), ("zlib net zlib license",)),
    Licence("zpl", "zope|zpl", "zope public|zpl( 2 [01])?", ("zpl 2 [01]",), ("zope org resources license",)),
]

# sentences by which a licence's text or notice is known, behind words that are in each of their
# alternatives: fixed values
NOTICES = [
    ("agpl", "affero", "free software foundation either version 3 of the gnu affero general public license"),
    ("apache", "compliance with the license", "you may not use this file except in compliance with the license"),
    ("apache", "unless required", "unless required by applicable law or agreed to in writing software distributed under the license"),
    ("artistic", "the intent", "the intent of this document is to state the conditions under which a package may be copied"),
    ("boost", "person or organization", "to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "contributors", "neither the name of .{0,80} nor the names of its contributors may be used to endorse or promote"),
    ("cc0", "neighboring rights", "waived all copyright and related or neighboring rights"),
    ("epl", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("gpl", "free software", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "general public", "you should have received a copy of the gnu general public license"),
    ("isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "lesser general", "free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("mit", "permission is hereby", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "substantial portions", "permission notice shall be included in all copies or substantial portions of the software"),
    ("mpl", "source code form", "this source code form is subject to the terms of the mozilla public license"),
    ("ofl", "font software", "this font software is licensed under the sil open font license"),
    ("proprietary", "all rights", "all rights reserved"),
    ("proprietary", "confidential", "(proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "written permission", "may not be (reproduced|copied|redistributed) (in any form )?without (prior )?written permission"),
    ("public-domain", "public domain", "(released|placed|dedicated) (in)?to the public domain"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "you just do", "you just do what the fuck you want to"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented"),
]

# one of these is in every text that a rule can match
ANCHORS = (
    "licen spdx under permi reserved confidential domain endorse misrepresented waived just copyleft "
    "cecill eclipse joinup lppl mozilla scripts consortium wtfpl"
).split()
GRANT = "(licen[cs]ed|released|distributed|available|provided|published|covered|governed|redistributed) under( the)?( terms( and conditions)? of)?( the| an?)?"
VERSION = "( ?v(ersion)? ?)?[1-4]( [0-9])?"
TAGGED, ADDRESS, NOTICE, GRANTED, VERSIONED, NAMED, ADJECTIVE, DUAL = range(1, 9)


def _rules() -> list[Rule]:
    found = [Rule(NOTICE, label, (keyword,), "", sentence) for label, keyword, sentence in NOTICES]
    for label, keywords, names, tags, addresses in LICENCES:
        own = tuple(keywords.split("|"))
        found += [Rule(TAGGED, label, ("spdx",), "licen", f"spdx licen[cs]e identifier ({tag})") for tag in tags]
        found += [Rule(ADDRESS, label, (address.split(" ")[0],), "", address) for address in addresses]
        found += [
            Rule(GRANTED, label, own, "under ", f"{GRANT} ({names})( licen[cs]e)?"),
            Rule(VERSIONED, label, own, "licen", f"({names}) licen[cs]e( agreement)?{VERSION}"),
            Rule(NAMED, label, own, "licen", f"({names}) licen[cs]e"),
            Rule(ADJECTIVE, label, own, "licen", f"({names}) licen[cs](ed|ing)"),
            Rule(DUAL, label, own, "licen", f"dual licen[cs]ed? .{{0,40}} ({names})"),
        ]
    return sorted(set(found))


RULES = _rules()
# how sure a detection is, by priority
CONFIDENCE = {TAGGED: 1.0, ADDRESS: 0.95, NOTICE: 0.95, GRANTED: 0.9, VERSIONED: 0.85, NAMED: 0.7, ADJECTIVE: 0.6, DUAL: 0.6}
