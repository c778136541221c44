"""The public set of license texts, notices, addresses and names that op9 scans for.

``*-full-text`` are whole texts from ``license_texts``; ``*-notice`` what files are headed
with; ``*-statement`` one sentence; ``*-url`` addresses without scheme; ``*-short`` and
``*-name`` abbreviations and names of one word or more, which are matched exactly.
"""

from __future__ import annotations

from importlib import resources

from .licenses import TEMPLATES

LESSER = "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either"
NO_WARRANTY = "but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU"

NOTICES = {
    "gpl-2.0-notice": f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, {NO_WARRANTY} General Public License for more details.",
    "lgpl-2.1-notice": f"This library is free software; you can redistribute it and/or modify it {LESSER} version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, {NO_WARRANTY} Lesser General Public License for more details.",
    "lgpl-3.0-notice": f"This program is free software: you can redistribute it and/or modify it {LESSER} version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, {NO_WARRANTY} Lesser General Public License for more details.",
    "agpl-3.0-notice": f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, {NO_WARRANTY} Affero General Public License for more details.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "epl-1.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "epl-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "gfdl-notice": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License",
    "bsl-1.0-notice": "Distributed under the Boost Software License, Version 1.0.",
    "bsd-style-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "mit-style-notice": "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.",
    "mit-license-statement": "Licensed under the MIT License",
    "unlicense-statement": "This is free and unencumbered software released into the public domain.",
    "public-domain-statement": "released into the public domain",
    "same-terms-statement": "under the same terms as Perl itself",
    "mit-name": "MIT License",
    "isc-name": "ISC License",
    "bsd-name": "BSD License",
    "bsd-2-clause-name": "BSD 2-Clause",
    "bsd-3-clause-name": "BSD 3-Clause",
    "zlib-name": "zlib License",
    "apache-name": "Apache License",
    "gpl-name": "GNU General Public License",
    "lgpl-name": "GNU Lesser General Public License",
    "lgpl-2.0-name": "GNU Library General Public License",
    "agpl-name": "GNU Affero General Public License",
    "gfdl-name": "GNU Free Documentation License",
    "mpl-name": "Mozilla Public License",
    "epl-name": "Eclipse Public License",
    "eupl-name": "European Union Public Licence",
    "cddl-name": "Common Development and Distribution License",
    "cpl-name": "Common Public License",
    "bsl-1.0-name": "Boost Software License",
    "ofl-name": "SIL Open Font License",
    "odbl-name": "Open Database License",
    "artistic-name": "Artistic License",
    "psf-name": "Python Software Foundation License",
    "unlicense-name": "The Unlicense",
    "unlicense-url": "unlicense.org",
    "wtfpl-short": "WTFPL",
    "cc0-short": "CC0 1.0",
    "cc0-url": "creativecommons.org/publicdomain/zero/1.0",
    "cc-public-domain-url": "creativecommons.org/publicdomain/mark/1.0",
    "apache-2.0-url": "www.apache.org/licenses/LICENSE-2.0",
    "mit-url": "opensource.org/licenses/MIT",
    "gnu-url": "www.gnu.org/licenses",
    "mpl-2.0-url": "mozilla.org/MPL/2.0",
    "all-rights-reserved": "All rights reserved.",
}

#: Abbreviated and written-out elements of Creative Commons licenses.
CC = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDeriv", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDeriv"}
PORTS = {"4.0": "International", "3.0": "Unported", "2.5": "Generic", "2.0": "Generic"}


def creative_commons() -> dict[str, str]:
    """Short form, address and statement of every license and version."""
    out = {}
    for version, port in PORTS.items():
        for short, name in CC.items():
            key = f"cc-{short}-{version}"
            name = name.replace("Deriv", "Derivatives" if version == "4.0" else "Derivs")
            out[f"{key}-short"] = f"CC {short} {version}"
            out[f"{key}-url"] = f"creativecommons.org/licenses/{short}/{version}"
            out[f"{key}-name"] = f"Creative Commons {name} {version}"
            out[f"{key}-statement"] = f"This work is licensed under a Creative Commons {name} {version} {port} License."
    return {k: v for k, v in out.items() if v not in TEMPLATES.values()}


def full_set() -> dict[str, str]:
    """All templates by name; a part that ``TEMPLATES`` has of a text that is here whole keeps its own name."""
    files = resources.files(__package__) / "license_texts"
    texts = {f"{f.name.removesuffix('.txt')}-full-text": f.read_text(encoding="utf-8") for f in files.iterdir() if f.name.endswith(".txt")}
    return TEMPLATES | NOTICES | creative_commons() | texts
