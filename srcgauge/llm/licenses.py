"""Licence scans by sentence rules, in built-in expressions only.

A text is cut into sentences; a sentence that speaks of licensing is normalised and
mapped to the identifiers of the known licence sentences it holds. The identifiers, in
text order, are matched against ordered licence rules: a rule takes the part of
the sequence that it matches, so a full licence text is recognised before the
short sentences it also holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GPL = r"(gnu )?(general public license|gpl)"
LGPL = r"(gnu )?(lesser|library) general public license|(gnu )?lgpl"
AGPL = r"(gnu )?affero general public license|(gnu )?agpl"
#: What follows the version where later ones are allowed.
LATER = r"(.{0,80}any later version|( of the licen[sc]e)?,? or (any )?(later|newer)|(\.0)?(\+|-or-later))"


def _version(names: str, number: str) -> str:
    """A licence and its version, close by or after some words."""
    return rf"({names})([ -]?|.{{0,80}}\b)(v\.? ?|version )?{number}"

#: Known sentences: (identifier, pattern on the normalised sentence), first match wins.
SENTENCES: list[tuple[str, str]] = [
    ("ApacheMayNotUse", r"you may not use this file except in compliance with the license"),
    ("ApacheObtain", r"you may obtain a copy of the license at"),
    ("ApacheUnless", r"unless required by applicable law or agreed to in writing"),
    ("ApacheLimits", r"see the license for the specific language governing permissions"),
    ("Apache2", r"apache (software |public )?licen[sc]e,? ?(v\.? ?|version )?2(\.0)?\b"
                r"|apache[ -]?(v\.? ?|version )?2(\.0)? licen[sc]e|\bapache-2\.0"
                r"|(licen[sc]ed|released|distributed|available) under (the )?apache[ -]?2(\.0)?\b"),
    ("MitGrant", r"permission is hereby granted,? free of charge,? to any person obtaining a copy"),
    ("MitNotice", r"above copyright notice and this permission notice shall be included"),
    ("IscGrant", r"permission to use,? copy,? modify,? and/?(or)? distribute this software for any purpose"),
    ("IscName", r"\bisc licen[sc]e"),
    ("BoostGrant", r"permission is hereby granted,? free of charge,? to any person or organization obtaining"),
    ("BoostNotice", r"copyright notices in the software and this entire statement"),
    ("Boost1", r"boost software licen[sc]e|\bbsl-1\.0"),
    ("ZlibGrant", r"permission is granted to anyone to use this software for any purpose"),
    ("ZlibOrigin", r"origin of this software must not be misrepresented"),
    ("ZlibAltered", r"altered source versions must be plainly marked as such"),
    ("ZlibNotice", r"this notice may not be removed or altered from any source distribution"),
    ("ZlibName", r"\bzlib(/libpng)? licen[sc]e"),
    ("WtfplTerms", r"you just do what the fuck you want to"),
    ("Wtfpl", r"do what the fuck you want to public licen[sc]e|\bwtfpl\b"),
    ("Artistic2", r"artistic licen[sc]e,? ?(v\.? ?|version )?2|\bartistic-2\.0"),
    ("Artistic1", r"artistic licen[sc]e,? ?(v\.? ?|version )?1|\bartistic-1\.0|(perl|original) artistic licen[sc]e"),
    ("Ofl11", r"sil open font licen[sc]e,? ?(v\.? ?|version )?1\.1|\bofl-1\.1"),
    ("Cddl1", r"common development and distribution licen[sc]e.{0,20}(v\.? ?|version )?1\.0|\bcddl-1\.0"),
    ("AsIs", r"(software|program|library|work) is provided .{0,40}as[ -]is"),
    ("NoLiability", r"in no event (shall|will) .{0,200}(be )?(held )?liable"),
    ("Mit", r"\b(mit|expat|x11)( ?/ ?x11)? licen[sc]e|licensed under (the )?(terms of (the )?)?mit\b"),
    ("BsdGrant", r"redistribution and use in source and binary forms,? with or without modification"),
    ("BsdSource", r"redistributions of source code must retain the above copyright notice"),
    ("BsdBinary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("BsdNames", r"neither the name of .{0,200}may be used to endorse or promote products"),
    ("Bsd3", r"bsd[ -]3[ -]clause|(3|three)[ -]clause bsd|\b(new|modified) bsd licen[sc]e"),
    ("Bsd2", r"bsd[ -]2[ -]clause|(2|two)[ -]clause bsd|\b(simplified bsd|freebsd) licen[sc]e"),
    ("Agpl3Later", _version(AGPL, "3") + LATER),
    ("Agpl3", _version(AGPL, "3")),
    ("Lgpl3Later", _version(LGPL, "3") + LATER),
    ("Lgpl21Later", _version(LGPL, r"2\.1") + LATER),
    ("Lgpl2Later", _version(LGPL, "2") + LATER),
    ("Lgpl3", _version(LGPL, "3")),
    ("Lgpl21", _version(LGPL, r"2\.1")),
    ("Lgpl2", _version(LGPL, "2")),
    ("GplNoWarranty", r"without any warranty"),
    ("GplReceived", r"you should have received a copy of the gnu"),
    ("Gpl3Later", _version(GPL, "3") + LATER),
    ("Gpl2Later", _version(GPL, "2") + LATER),
    ("Gpl3", _version(GPL, "3")),
    ("Gpl2", _version(GPL, "2")),
    ("Mpl2", r"mozilla public licen[sc]e,? ?(v|version )?\.? ?2|\bmpl[ -]?(v\.? ?|version )?2"),
    ("Mpl11", r"mozilla public licen[sc]e,? ?(v|version )?\.? ?1\.1|\bmpl[ -]?(v\.? ?|version )?1\.1"),
    ("Epl2", r"eclipse public licen[sc]e,? ?(- )?(v|version )?\.? ?2|\bepl[ -]?(v\.? ?|version )?2"),
    ("Epl1", r"eclipse public licen[sc]e,? ?(- )?(v|version )?\.? ?1|\bepl[ -]?(v\.? ?|version )?1"),
    ("Cc0", r"\bcc0\b|creative commons zero"),
    ("Unlicense", r"free and unencumbered software released into the public domain"),
    ("PublicDomain", r"(released|placed|dedicated|is) (in|into|to) the public domain"),
    ("Reserved", r"all rights reserved"),
]
#: Creative Commons licences: letters and their long names.
CC_PARTS = {
    "BY": "attribution", "BY-SA": "attribution[ -]share ?alike",
    "BY-NC": "attribution[ -]non ?commercial", "BY-ND": "attribution[ -]no ?deriv(ative)?s",
    "BY-NC-SA": "attribution[ -]non ?commercial[ -]share ?alike",
    "BY-NC-ND": "attribution[ -]non ?commercial[ -]no ?deriv(ative)?s",
}
CC_VERSIONS = ("4.0", "3.0", "2.5", "2.0")
for _letters in sorted(CC_PARTS, key=len, reverse=True):
    for _version in CC_VERSIONS:
        _v = _version.replace(".", r"\.")
        SENTENCES.append(
            (
                f"Cc{_letters}-{_version}".replace("-", "_"),
                rf"\bcc[ -]{_letters.lower()}[ -]{_v}"
                rf"|creative commons {CC_PARTS[_letters]} {_v}( |$)"
                rf"|creative commons {CC_PARTS[_letters]} (international )?licen[sc]e.{{0,20}}{_v}",
            )
        )

#: Ordered rules: (licence, pattern on the identifiers, each between spaces).
RULES: list[tuple[str, str]] = [
    ("Apache-2.0", "( Apache2 )?( ApacheMayNotUse )( ApacheObtain )?( Apache2 )?( ApacheUnless )?( ApacheLimits )?"),
    ("MIT", "( Mit )?( MitGrant )( MitNotice )?( AsIs )?( NoLiability )?"),
    ("ISC", "( IscName )?( IscGrant )( AsIs )?( NoLiability )?"),
    ("BSL-1.0", "( Boost1 )?( BoostGrant )( BoostNotice )?( AsIs )?( NoLiability )?"),
    ("Zlib", "( ZlibName )?( AsIs )?( NoLiability )?( ZlibGrant )?( ZlibOrigin )( ZlibAltered )?( ZlibNotice )?"),
    ("WTFPL", "( Wtfpl ){0,2}( WtfplTerms )"),
    ("BSD-3-Clause", "( Bsd3 )?( BsdGrant )( BsdSource )( BsdBinary )( BsdNames )( AsIs )?( NoLiability )?"),
    ("BSD-2-Clause", "( Bsd2 )?( BsdGrant )( BsdSource )( BsdBinary )( AsIs )?( NoLiability )?"),
    ("AGPL-3.0-or-later", "( Agpl3Later )( GplNoWarranty )?( GplReceived )?"),
    ("GPL-3.0-or-later", "( Gpl3Later )( GplNoWarranty )?( GplReceived )?"),
    ("GPL-2.0-or-later", "( Gpl2Later )( GplNoWarranty )?( GplReceived )?"),
    ("LGPL-3.0-or-later", "( Lgpl3Later )( GplNoWarranty )?( GplReceived )?"),
    ("LGPL-2.1-or-later", "( Lgpl21Later )( GplNoWarranty )?( GplReceived )?"),
    ("LGPL-2.0-or-later", "( Lgpl2Later )( GplNoWarranty )?( GplReceived )?"),
    ("AGPL-3.0-only", "( Agpl3 )( GplNoWarranty )?( GplReceived )?"),
    ("LGPL-3.0-only", "( Lgpl3 )( GplNoWarranty )?( GplReceived )?"),
    ("LGPL-2.1-only", "( Lgpl21 )( GplNoWarranty )?( GplReceived )?"),
    ("LGPL-2.0-only", "( Lgpl2 )( GplNoWarranty )?( GplReceived )?"),
    ("GPL-3.0-only", "( Gpl3 )( GplNoWarranty )?( GplReceived )?"),
    ("GPL-2.0-only", "( Gpl2 )( GplNoWarranty )?( GplReceived )?"),
    ("Apache-2.0", "( Apache2 )"),
    ("MIT", "( Mit )"),
    ("BSD-3-Clause", "( Bsd3 )"),
    ("BSD-2-Clause", "( Bsd2 )"),
    ("ISC", "( IscName )"),
    ("BSL-1.0", "( Boost1 )"),
    ("Zlib", "( ZlibName )"),
    ("WTFPL", "( Wtfpl )"),
    ("Artistic-2.0", "( Artistic2 )"),
    ("Artistic-1.0", "( Artistic1 )"),
    ("OFL-1.1", "( Ofl11 )"),
    ("CDDL-1.0", "( Cddl1 )"),
    ("MPL-2.0", "( Mpl2 )"),
    ("MPL-1.1", "( Mpl11 )"),
    ("EPL-2.0", "( Epl2 )"),
    ("EPL-1.0", "( Epl1 )"),
    ("CC0-1.0", "( Cc0 )"),
    ("Unlicense", "( Unlicense )"),
    ("LicenseRef-public-domain", "( PublicDomain )"),
    *(
        (f"CC-{letters}-{version}", f"( Cc{letters}_{version} )".replace("-", "_"))
        for letters in CC_PARTS
        for version in CC_VERSIONS
    ),
]

#: Every known sentence holds one of these; other sentences are not looked at.
TRIGGER = (
    "licen[sc]e|spdx|copyright|permission|warranty|redistribution|liable|endorse|gpl|apache|bsd"
    "|is provided|public domain|all rights reserved|cc[ -]by|cc0|creative commons"
    "|received a copy|applicable law|free and unencumbered|removed or altered|misrepresented|plainly marked"
    r"|you just do what|wtfpl|\bmpl|\bepl|\bcddl|\bofl-1|\bartistic-|\bbsl-1"
)
#: The same on a text that is not normalised: anything may stand between its words.
BETWEEN = "[^a-z0-9.,:+/-]+"
RAW_TRIGGER = TRIGGER.replace("[ -]", f"(-|{BETWEEN})").replace(" ", BETWEEN)
#: A sentence with one of these that is not known is counted as such.
LICENSING = "licen[sc]e|spdx|copyright"
SPDX = r"spdx-license-identifier: ?([a-z0-9.+-]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A whole SPDX expression in a lower-case text; an exception (after "with") is no licence.
SPDX_IDS = (
    r"spdx-license-identifier:[^a-z0-9.,:+/-]*"
    r"([a-z0-9.+-]+(?:[ \t()]+(?:or|and|with)[ \t(]+[a-z0-9.+-]+)*)"
)
#: What stands for an SPDX expression in the text that the other patterns see.
TAGGED = "/:/"

# The GNU patterns are read so that one mention of a licence is one identifier: from a
# name to its version there is no other licence's name and no other version, and the
# mentions already known are taken out.
GNU = [name for name, _ in SENTENCES if name.startswith(("Agpl", "Lgpl", "Gpl2", "Gpl3"))]
MARKS = {name: chr(0xE000 + i) for i, name in enumerate(GNU)}
OTHER_NAME = (
    r"gpl|general public licen|apache|mozilla|eclipse|creative commons|cc[ -]by|\bcc0"
    r"|\b(?:mit|bsd|isc|mpl|epl)\b"
)
GNU_MENTION = "gpl|general public licen"
#: "gpl version 2 or version 3" names the licence once.
SHARED_NAME = (
    r"((?:lesser |library |affero )?general public license|[al]?gpl)([ -]?,? ?(?:v|version )?[23](?:\.[01])?)"
    r"( or | and | ?/ ?|, ?)((?:v|version )?[23](?:\.[01])?\b)(?! [a-z]+ (?:19|20))"
)


def _gnu_pattern(name: str, pattern: str) -> str:
    version = next(v for v in ("21", "2", "3") if v in name)
    own = {"21": r"2\.1", "2": r"2(?!\.1)", "3": "3"}[version]
    if version == "2":
        pattern = pattern.replace("version )?2", "version )?2(?!\\.1)")
    between = rf"(?:(?!{OTHER_NAME}|\b(?:v|version )(?!{own})[0-9])[^\ue000-\ue0ff])"
    pattern = pattern.replace("(gnu )?", "")
    if name.startswith("Gpl"):
        pattern = pattern.replace(
            "(general public license|gpl)",
            "(?:(?<!lesser )(?<!library )(?<!affero )general public license|(?<![al])gpl)",
        )
    return pattern.replace(".{0,80}", f"{between}{{0,80}}?")


#: Patterns as they are looked for in a sentence that may hold several.
ALL_PATTERNS = {
    name: _gnu_pattern(name, pattern)
    if name in GNU
    else rf"(?<!unencumbered software )({pattern})"  # known as Unlicense
    if name == "PublicDomain"
    else pattern
    for name, pattern in SENTENCES
}
#: Ends of sentences: a mark and white space, an empty line, or a colon before a list. A
#: semicolon ends none: licence notices go on behind it.
SENTENCE_END = (
    r"([.!?][ \t\n\r\f]+|\n[ \t\r]*\n[ \t\n\r\f]*"
    r"|:[ \t\r]*\n[ \t\n\r\f]*(?=(?:[*+\u2022-]|\(?[0-9a-z]{1,3}[.)])[ \t]))"
)
#: A mark that ends no sentence.
VERSION_MARK = r"([^a-z0-9])v\.[ \t\n\r\f]+([0-9])"
CUT = "\x1e"
UNKNOWN = "?"


def sentences(text: str | Column) -> Column:
    """Sentences of a text in lower case, as they are written."""
    text = F.col(text) if isinstance(text, str) else text
    lower = F.translate(text, UPPER, LOWER)
    lower = F.regexp_replace(lower, VERSION_MARK, "$1v $2")
    return F.split(F.regexp_replace(lower, SENTENCE_END, f"$1{CUT}"), CUT)


def normalised(sentence: Column) -> Column:
    """Lower-case ASCII words, one space between them."""
    return F.trim(F.regexp_replace(sentence, r"[^a-z0-9.,:+/-]+", " "))


def spdx_ids(sentence: Column) -> Column:
    """The licences that a sentence's SPDX expressions name."""
    found = F.regexp_extract_all(sentence, F.lit(SPDX_IDS), F.lit(1))
    words = F.flatten(F.transform(found, lambda e: F.split(
        F.regexp_replace(e, r"[ \t()]+with[ \t(]+[^ \t()]+", ""), r"[ \t()]+(?:or|and)[ \t(]+"
    )))
    ids = F.transform(words, lambda w: F.rtrim(w, F.lit(".")))
    return F.transform(F.filter(ids, lambda i: i != ""), lambda i: F.concat(F.lit("Spdx:"), i))


def gnu_marks(sentence: Column) -> Column:
    """A normalised sentence with a mark for each GNU licence that it mentions."""
    marked = F.regexp_replace(sentence, SHARED_NAME, "$1$2$3$1 $4")
    for name in GNU:
        marked = F.regexp_replace(marked, ALL_PATTERNS[name], MARKS[name])
    return F.when(sentence.rlike(GNU_MENTION), marked).otherwise("")


def sentence_ids(sentence: Column, marked: Column) -> Column:
    """Identifiers of the known sentences in a normalised sentence, in text order."""

    def place(name: str) -> Column:
        if name in MARKS:
            return F.when(marked.contains(MARKS[name]), F.instr(marked, MARKS[name])).otherwise(0)
        return F.regexp_instr(sentence, F.lit(ALL_PATTERNS[name]))

    def placed(names: list[str]) -> Column:
        return F.array(*[F.struct(place(n).alias("at"), F.lit(n).alias("id")) for n in names])

    nothing = F.array().cast("array<struct<at:int,id:string>>")
    cc = [name for name in ALL_PATTERNS if name.startswith("Cc") and name != "Cc0"]
    plain = [name for name in ALL_PATTERNS if name not in cc and name not in MARKS]
    found = F.concat(
        placed(plain),
        F.when(marked != "", placed(list(MARKS))).otherwise(nothing),
        F.when(sentence.rlike("cc[ -]|creative commons"), placed(cc)).otherwise(nothing),
    )
    found = F.array_sort(F.filter(found, lambda x: x["at"] > 0))
    return F.transform(found, lambda x: x["id"])


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, licenses, sentence_ids, n_known, n_unknown.

    ``licenses`` holds the licences found, sorted and joined by commas ('' if none);
    ``sentence_ids`` the known sentences' identifiers in text order, joined by spaces
    (a sentence of several licences has several); ``n_known`` counts these identifiers,
    ``n_unknown`` other sentences that speak of a licence or copyright. A null
    or empty text has none of these. Rows are independent: repeated rows and null ids
    stay as they are, an empty table gives no rows, other columns are ignored. One
    narrow pass over whole texts.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    speaks = F.coalesce(F.col("text").rlike(f"(?i){RAW_TRIGGER}"), F.lit(False))
    parts = F.transform(
        sentences("text"),
        lambda s: F.struct(
            spdx_ids(s).alias("tags"),
            normalised(F.regexp_replace(s, SPDX_IDS, f" {TAGGED} ")).alias("text"),
            normalised(s).alias("whole"),
        ),
    )
    parts = F.filter(parts, lambda p: p["whole"].rlike(TRIGGER))
    parts = F.transform(
        parts, lambda p: F.struct(p["tags"], p["text"], p["whole"], gnu_marks(p["text"]).alias("marked"))
    )
    ids = F.transform(
        parts, lambda p: F.array_distinct(F.concat(p["tags"], sentence_ids(p["text"], p["marked"])))
    )
    unknown = F.transform(
        parts,
        lambda p: F.when(p["whole"].rlike(LICENSING), F.array(F.lit(UNKNOWN))).otherwise(
            F.array().cast("array<string>")
        ),
    )
    ids = F.flatten(F.zip_with(ids, unknown, lambda i, u: F.when(F.size(i) > 0, i).otherwise(u)))
    ids = F.when(speaks, ids).otherwise(F.array().cast("array<string>"))
    rows = rows.select("doc_id", ids.alias("ids"))
    known = F.filter("ids", lambda i: i != UNKNOWN)
    unknown = F.size(F.filter("ids", lambda i: i == UNKNOWN))
    rows = rows.select("doc_id", known.alias("known"), unknown.alias("n_unknown"))
    rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("rule")) for n, p in RULES])
    start = F.struct(
        F.concat(F.lit(" "), F.concat_ws("  ", "known"), F.lit(" ")).alias("rest"),
        F.array().cast("array<string>").alias("found"),
    )
    matched = F.aggregate(
        rules,
        start,
        lambda state, r: F.struct(
            F.regexp_replace(state.rest, r["rule"], "").alias("rest"),
            F.when(
                F.regexp_like(state.rest, r["rule"]),
                F.array_append(state.found, r["name"]),
            ).otherwise(state.found).alias("found"),
        ),
        lambda state: state.found,
    )
    tagged = F.transform(
        F.filter("known", lambda i: i.startswith("Spdx:")), lambda i: F.substr(i, F.lit(6))
    )
    found = F.array_sort(F.array_distinct(F.concat(matched, tagged)))
    licenses = F.when(F.size("known") > 0, F.concat_ws(",", found)).otherwise("")
    return rows.select(
        "doc_id", licenses.alias("licenses"), F.concat_ws(" ", "known").alias("sentence_ids"),
        F.size("known").cast("long").alias("n_known"), F.col("n_unknown").cast("long"),
    )
