"""Public license texts as they are shipped, plain and behind comment marks, by the names their authors give them."""

import pytest

from sightline.llm.license_scan import scan_licenses

MIT_GRANT = '''Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so'''
AS_IS = '''THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.'''
MIT = f'''MIT License

Copyright (c) 2020 Somebody Else

{MIT_GRANT}, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

{AS_IS}
'''
BSD = '''Copyright (c) 1994, 1995 The Regents. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
'''
BSD_END = '''
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
'''
GPL = '''This program is free software: you can redistribute it and/or modify
it under the terms of the GNU {name} as published by
the Free Software Foundation, either version {version} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
GNU {name} for more details.
'''
OLD_GPL = '''This program is free software; you can redistribute it and/or modify
it under the terms of the GNU {name} as published by
the Free Software Foundation; either version {version} of the License, or
(at your option) any later version.
'''
PERMIT = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted"

TEXTS = [
    ("MIT", MIT),
    ("MIT", MIT.replace("MIT License\n\n", "").replace("subject to the following conditions", "subject to these terms")),
    ("MIT-0", f"MIT No Attribution\n\nCopyright 2021 Somebody\n\n{MIT_GRANT}.\n\n{AS_IS}\n"),
    ("BSD-2-Clause", BSD + BSD_END),
    ("BSD-3-Clause", BSD + "\n3. Neither the name of the University nor the names of its contributors may be\n   used to endorse or promote products derived from this software without\n   specific prior written permission.\n" + BSD_END),
    ("BSD-3-Clause", BSD + "\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n" + BSD_END),
    ("BSD-3-Clause", BSD + "\n3. The name of the author may not be used to endorse or promote products\n   derived from this software without specific prior written permission.\n" + BSD_END),
    ("Apache-2.0", '''Copyright 2019 Somebody

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
'''),
    ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n"),
    ("GPL-3.0", GPL.format(name="General Public License", version="3")),
    ("GPL-2.0", OLD_GPL.format(name="General Public License", version="2")),
    ("LGPL-3.0", GPL.format(name="Lesser General Public License", version="3")),
    ("LGPL-2.1", OLD_GPL.format(name="Lesser General Public License", version="2.1")),
    ("AGPL-3.0", GPL.format(name="Affero General Public License", version="3")),
    ("GPL-3.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n"),
    ("GPL-2.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n The licenses for most software are designed to take away your freedom.\n"),
    ("LGPL-2.1", "                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999\n\n Preamble\n"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.\n"),
    ("MPL-2.0", "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n--------------\n"),
    ("ISC", f"ISC License\n\nCopyright (c) 2018, Somebody\n\n{PERMIT}, provided that the above\ncopyright notice and this permission notice appear in all copies.\n"),
    ("0BSD", f"Copyright (C) 2022 by Somebody\n\n{PERMIT}.\n\nTHE SOFTWARE IS PROVIDED AS GIVEN.\n"),
    ("Zlib", "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented.\n"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person.\n"),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy this.\n"),
    ("CC0-1.0", "Creative Commons Legal Code\n\nCC0 1.0 Universal\n\n    CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM.\n"),
    ("CC-BY-4.0", "Attribution 4.0 International\n\n=======================================================================\n\nCreative Commons Corporation is not a law firm.\n"),
    ("CC-BY-SA-4.0", "Attribution-ShareAlike 4.0 International\n\n=======================================\n\nUsing Creative Commons Public Licenses.\n"),
    ("PostgreSQL", "Permission to use, copy, modify, and distribute this software and its\ndocumentation for any purpose, without fee, and without a written agreement\nis hereby granted, provided that the above copyright notice and this\nparagraph and the following two paragraphs appear in all copies.\n"),
    ("EPL-2.0", "Eclipse Public License - v 2.0\n\n    THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS LICENSE.\n"),
    ("OFL-1.1", "Copyright 2010 Somebody\n\nThis Font Software is licensed under the SIL Open Font License, Version 1.1.\nThis license is copied below.\n"),
    ("MIT", "SPDX-License-Identifier: MIT\nint main() { return 0; }\n"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0 */\npackage x;\n"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only\n"),
    ("LGPL-2.1", "SPDX-License-Identifier: (LGPL-2.1-or-later OR MIT)\n"),
    (None, "A text about licenses: the MIT one is short.\n\nCopyright 2020 Nobody. All rights reserved.\n"),
]
FORMS = {"plain": lambda t: t, "slashes": lambda t: "".join(f"// {x}".rstrip() + "\n" for x in t.splitlines()), "hash": lambda t: "".join(f"# {x}\n" for x in t.splitlines()), "stars": lambda t: "/*\n" + "".join(f" * {x}\n" for x in t.splitlines()) + " */\ncode();\n", "windows": lambda t: t.replace("\n", "\r\n")}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(f"{form}/{i}", change(t)) for form, change in FORMS.items() for i, (_, t) in enumerate(TEXTS)]
    return {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()}


@pytest.mark.parametrize("form", sorted(FORMS))
def test_names(found, form):
    got = [(name, found[f"{form}/{i}"].license, i) for i, (name, _) in enumerate(TEXTS)]
    assert [g for g in got if g[0] != g[1]] == []


def test_one_license_a_text(found):
    for i, (name, _) in enumerate(TEXTS):
        others = set(found[f"plain/{i}"].licenses.split(",")) - {name, ""}
        assert not others, (name, others)


def test_many_blank_lines(spark):
    text = "\n" * 200_000 + MIT + "\n \n" * 100_000
    assert scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().license == "MIT"
