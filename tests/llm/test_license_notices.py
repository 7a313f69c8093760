"""Notices that differ from those of other licenses in few words."""

import pytest

from samplelake.llm import licenses

TEMPLATES = [licenses.Template.of(*t) for t in licenses.TEMPLATES]


@pytest.mark.parametrize(("line", "want"), [
    ("Released under the BSD License", ["BSD"]),
    ("Released under the MIT License", ["MIT"]),
    ("Released under the Foo License", []),
    ("Released under the BSD 2-Clause License.", ["BSD-2-Clause"]),
    ("Released under the ISC License", ["ISC"]),
    ("Licensed under CC BY-SA 4.0", ["CC-BY-SA-4.0"]),
    ("Licensed under CC BY 4.0", ["CC-BY-4.0"]),
    ("Licensed under CC BY-NC 4.0", ["CC-BY-NC-4.0"]),
    ("Licensed under CC BY-NC-SA 3.0", ["CC-BY-NC-SA-3.0"]),
    ("Licensed under CC BY-NC 9.0", []),
    ("licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["CC-BY-SA-4.0"]),
    ("This work is licensed under the GNU General Public License, version 2", ["GPL-2.0"]),
    ("This work is licensed under the GNU General Public License, version 3", ["GPL-3.0"]),
    ("This work is licensed under the GNU Lesser General Public License, version 3", ["LGPL-3.0"]),
    ("This work is licensed under the GNU Lesser General Public License, version 2.1", ["LGPL-2.1"]),
    ("This work is licensed under the GNU Affero General Public License, version 3", ["AGPL-3.0"]),
    ("it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 "
     "of the License, or (at your option) any later version.", ["GPL-2.0-or-later"]),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ["MPL-2.0"]),
    ("Licensed under the Apache License, Version 1.1", []),
    ("Released under CC0 1.0", ["CC0-1.0"]),
    ("This is free and unencumbered software released into the public domain.", ["Unlicense"]),
    (licenses._BSD_2, ["BSD-2-Clause"]),
    (licenses._BSD_3.replace("copyright holder", "University"), ["BSD-3-Clause"]),
])
def test_near_misses(line, want):
    for text in (line, f"Some words before. {line}\nand some words after it."):
        assert [name for name, *_ in licenses.notices(text, TEMPLATES, licenses.COVERAGE)] == want
