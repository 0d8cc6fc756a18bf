import pytest

import __spark_entry__ as entry
from srcgauge.llm.licenses import license_scan
from tests.oracle_check import compare

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software, to deal in it without restriction. The above copyright notice and this
permission notice shall be included in all copies. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are
permitted. Redistributions of source code must retain the above copyright notice.
Redistributions in binary form must reproduce the above copyright notice."""
NAMES = """ Neither the name of the owner nor the names of contributors may be used to endorse or
promote products."""
CASES = [
    ("Words here. Released under the MIT License.", "MIT"),
    ("no mark at the end\nLicensed under the Apache License, Version 2.0. And more.", "Apache-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0-only"),
    ("GNU General Public License as published, either version 3 of the License, or any later version.", "GPL-3.0-or-later"),
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    ("Creative Commons Attribution-ShareAlike 4.0", "CC-BY-SA-4.0"),
    ("// SPDX-License-Identifier: MPL-1.1\ncode", "mpl-1.1"),
    (MIT, "MIT"),
    (f"Foo.\n\n{BSD}", "BSD-2-Clause"),
    (BSD + NAMES, "BSD-3-Clause"),
    (f"{MIT}\n\n{BSD}{NAMES} Also under the Mozilla Public License, v. 2.0.", "BSD-3-Clause,MIT,MPL-2.0"),
    ("The licence of poets is wide. Copyright 2001.", ""),
    ("All rights reserved.", ""),
    ("", ""),
    (None, ""),
]


def test_cases(spark, frame):
    df = frame([(i, text) for i, (text, _) in enumerate(CASES)])
    got = {r.doc_id: r for r in license_scan(df).collect()}
    assert [got[i].licenses for i in range(len(CASES))] == [want for _, want in CASES]
    assert got[7].sentence_ids == "MitGrant MitNotice AsIs NoLiability"
    assert got[11].n_unknown == 2 and got[11].n_known == 0


def test_query_equals_its_twin(spark, con, sf_dir):
    name = "op10_sentence_rules"
    assert compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], sf_dir) == ""


@pytest.mark.parametrize("text", ["x " * 100_000 + "Released under the MIT License.", "a.\n" * 50_000])
def test_long_texts_repeats_and_null_ids(spark, frame, text):
    df = frame([(None, text), (1, text), (1, text)])
    want = "MIT" if "MIT" in text else ""
    assert [r.licenses for r in license_scan(df).collect()] == [want] * 3
    assert license_scan(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Dual-licensed under the MIT License or the Apache License, Version 2.0.", "Apache-2.0,MIT"),
        ("// SPDX-License-Identifier: MIT OR Apache-2.0\nand code", "apache-2.0,mit"),
        ("SPDX-License-Identifier: MIT\nSPDX-License-Identifier: (BSD-3-Clause AND Zlib)", "bsd-3-clause,mit,zlib"),
        ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", "gpl-2.0-only"),
        ("SPDX-License-Identifier: MPL-1.1\nLicensed under the Apache License, Version 2.0", "Apache-2.0,mpl-1.1"),
        ("SPDX-License-Identifier: LicenseRef-" + "x" * 300, "licenseref-" + "x" * 300),
        ("GNU Lesser General Public License version 2.1, or any later version.", "LGPL-2.1-or-later"),
        ("Under the GPL version 2 or the LGPL version 2.1.", "GPL-2.0-only,LGPL-2.1-only"),
        ("Under the GPL version 2 or version 3.", "GPL-2.0-only,GPL-3.0-only"),
        ("GNU General Public License Version 3, 29 June 2007", "GPL-3.0-only"),
        ("Under the GPL or the Apache License, Version 2.0.", "Apache-2.0"),
        ("free and unencumbered software released into the public domain", "Unlicense"),
    ],
)
def test_every_licence_of_a_sentence(frame, text, want):
    assert license_scan(frame([(1, text)])).first().licenses == want


BULLETS = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:{}* Redistributions of source
code must retain the above copyright notice, this list of conditions{}* Redistributions in binary form
must reproduce the above copyright notice, this list of conditions{}* Neither the name of the owner nor
the names of contributors may be used to endorse or promote products"""


@pytest.mark.parametrize("gap", ["\n\n", "\n", "\n \n  "])
def test_bulleted_licence(frame, gap):
    row = license_scan(frame([(1, BULLETS.format(gap, gap, gap))])).first()
    assert row.licenses == "BSD-3-Clause"
    assert row.sentence_ids == "BsdGrant BsdSource BsdBinary BsdNames"


def test_an_empty_line_ends_a_sentence(frame):
    row = license_scan(frame([(1, "The licence of poets\n\nCopyright 2001")])).first()
    assert row.n_unknown == 2


GNU_NOTICE = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU {} as published by
the Free Software Foundation; either version {} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {} for more details.

You should have received a copy of the GNU {}
along with this program; if not, see the licenses' page.
"""
ONLY = "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event
will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial
applications, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote it.
2. Altered source versions must be plainly marked as such.
3. This notice may not be removed or altered from any source distribution."""
BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the
software and accompanying documentation covered by this license to use it. The copyright notices in
the Software and this entire statement must be included in all copies. THE SOFTWARE IS PROVIDED "AS
IS", WITHOUT WARRANTY OF ANY KIND. IN NO EVENT SHALL THE COPYRIGHT HOLDERS BE LIABLE FOR ANY DAMAGES."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or
without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS". IN NO EVENT SHALL THE AUTHOR BE LIABLE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software is distributed on an "AS IS"
BASIS. See the License for the specific language governing permissions and limitations."""


def gnu(name, version):
    return GNU_NOTICE.format(name, version, name, name)


NOTICES = [
    (gnu("General Public License", "2"), "GPL-2.0-or-later"),
    (gnu("General Public License", "3"), "GPL-3.0-or-later"),
    (gnu("Lesser General Public License", "2.1"), "LGPL-2.1-or-later"),
    (gnu("Lesser General Public License", "3"), "LGPL-3.0-or-later"),
    (gnu("Library General Public License", "2"), "LGPL-2.0-or-later"),
    (gnu("Affero General Public License", "3"), "AGPL-3.0-or-later"),
    (ONLY, "GPL-2.0-only"),
    (ZLIB, "Zlib"),
    (BOOST, "BSL-1.0"),
    (ISC, "ISC"),
    (APACHE, "Apache-2.0"),
    ("Licensed under the Apache License 2.0", "Apache-2.0"),
    ("Licensed under the Apache License v2.0.", "Apache-2.0"),
    ("The Apache server of 2004 has a licence.", ""),
    ("License: GPLv2+", "GPL-2.0-or-later"),
    ("License: GPLv2", "GPL-2.0-only"),
    ("License: GPL-3.0-or-later", "GPL-3.0-or-later"),
    ("Released under GPL version 2 or later.", "GPL-2.0-or-later"),
    ("License: LGPLv2.1+", "LGPL-2.1-or-later"),
    ("License: LGPLv3", "LGPL-3.0-only"),
    ("License: AGPLv3+", "AGPL-3.0-or-later"),
    ("Under the GPL v3 or the Apache License 2.0.", "Apache-2.0,GPL-3.0-only"),
    ("Under the zlib License.", "Zlib"),
    ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"),
    ("Under the ISC license", "ISC"),
    ("Under the Artistic License 2.0", "Artistic-2.0"),
    ("Under the original Artistic License", "Artistic-1.0"),
    ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\n\n 0. You just DO WHAT THE FUCK YOU WANT TO.", "WTFPL"),
    ("Under the SIL Open Font License, Version 1.1.", "OFL-1.1"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "MPL-2.0"),
    ("Mozilla Public License Version 1.1", "MPL-1.1"),
    ("Eclipse Public License - v 1.0", "EPL-1.0"),
]


def test_standard_notices_and_short_names(frame):
    rows = license_scan(frame([(i, text) for i, (text, _) in enumerate(NOTICES)])).collect()
    got = {r.doc_id: r.licenses for r in rows}
    assert [(t[:40], got[i]) for i, (t, _) in enumerate(NOTICES)] == [(t[:40], want) for t, want in NOTICES]


def test_a_semicolon_ends_no_sentence(frame):
    row = license_scan(frame([(1, gnu("General Public License", "2"))])).first()
    assert row.sentence_ids == "Gpl2Later GplNoWarranty GplReceived"
