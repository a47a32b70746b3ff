"""Statements and notices of public licences, as the licence scan's templates."""

from __future__ import annotations

# Phrases that always count, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices as their licences ask to print them.
NOTICES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the
above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution.""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the
above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution. Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from this software without specific prior written
permission.""",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License.""",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy,
modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any means.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors
be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to
the following restrictions""",
    "bsl-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the
software and accompanying documentation covered by this license (the "Software") to use, reproduce, display,
distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit
third-parties to whom the Software is furnished to do so""",
}

# The notice of the GNU licences, and (label, noun, name, version) of each.
GNU_NOTICE = """This {noun} is free software; you can redistribute it and/or modify it under the terms of the GNU {name}
as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later
version."""
GNU = [
    ("gpl-2.0-or-later", "program", "General Public License", "2"),
    ("gpl-3.0-or-later", "program", "General Public License", "3"),
    ("lgpl-2.1-or-later", "library", "Lesser General Public License", "2.1"),
    ("lgpl-3.0-or-later", "library", "Lesser General Public License", "3"),
    ("agpl-3.0-or-later", "program", "Affero General Public License", "3"),
]

# What stands before a licence's name in a one-line statement, and names.
SAID = ["licensed under", "released under", "distributed under"]
NAMES = {
    "mit": ["the MIT License"],
    "apache-2.0": ["the Apache License, Version 2.0"],
    "gpl-2.0": ["the GNU General Public License, version 2"],
    "gpl-3.0": ["the GNU General Public License, version 3"],
    "lgpl-2.1": ["the GNU Lesser General Public License, version 2.1"],
    "lgpl-3.0": ["the GNU Lesser General Public License, version 3"],
    "agpl-3.0": ["the GNU Affero General Public License, version 3"],
    "mpl-2.0": ["the Mozilla Public License, version 2.0"],
    "cc0-1.0": ["CC0 1.0", "the CC0 1.0 Universal"],
}
# Creative Commons' elements in full, in order of their short names, and the versions.
COMMONS = {
    "by": "Attribution",
    "by-sa": "Attribution-ShareAlike",
    "by-nc": "Attribution-NonCommercial",
    "by-nd": "Attribution-NoDerivatives",
    "by-nc-sa": "Attribution-NonCommercial-ShareAlike",
    "by-nc-nd": "Attribution-NonCommercial-NoDerivatives",
}
COMMONS_VERSIONS = ["2.0", "3.0", "4.0"]


def templates() -> list[tuple[str, str]]:
    """(label, text) of every template."""
    out = [*NOTICES.items()]
    out += [(label, GNU_NOTICE.format(noun=noun, name=name, version=version)) for label, noun, name, version in GNU]
    out += [(label, f"{said} {name}") for label, names in NAMES.items() for name in names for said in SAID]
    for short, long in COMMONS.items():
        for version in COMMONS_VERSIONS:
            out += [(f"cc-{short}-{version}", f"{said} {name}") for said in SAID for name in (f"CC {short} {version}", f"a Creative Commons {long} {version} International License")]
    return out
