"""The words of public licences' texts and notices, as their authors publish them.

Each has a label, a text, phrases that must stand at their places in it, and
phrases that stand in another licence of nearly the same text and so rule it out.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrases: tuple[str, ...]
    without: tuple[str, ...] = ()


_AS_IS = """
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
_BSD = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.
"""
_BSD_WARRANTY = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
"""
_ISC_WARRANTY = """
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS.
"""


def _gnu(name: str, version: str) -> str:
    return f"""
This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software
Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be
useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more
details.
"""


def _commons(kind: str) -> str:
    return f"This work is licensed under a Creative Commons {kind} 4.0 International License."


TEMPLATES = (
    Template(
        "mit",
        """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
"""
        + _AS_IS,
        ("permission is hereby granted free of charge", "to deal in the software without restriction", "shall be included in all copies"),
        ("except as contained in this notice",),
    ),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", ("permission is hereby granted free of charge", "any person obtaining a copy"), ("except as contained in this notice",)),
    Template(
        "x11",
        """
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND. Except as contained in this notice, the name of the X Consortium shall not be used in advertising or
otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium.
""",
        ("except as contained in this notice", "shall not be used in advertising or otherwise to promote the sale"),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies." + _ISC_WARRANTY,
        ("for any purpose with or without fee is hereby granted", "this permission notice appear in all copies"),
    ),
    Template(
        "0bsd",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted." + _ISC_WARRANTY,
        ("for any purpose with or without fee is hereby granted",),
        ("this permission notice appear in all copies",),
    ),
    Template("bsd-2-clause", _BSD + _BSD_WARRANTY, ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce"), ("neither the name", "all advertising materials")),
    Template(
        "bsd-3-clause",
        _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission." + _BSD_WARRANTY,
        ("redistributions in binary form must reproduce", "neither the name", "may be used to endorse or promote products"),
        ("all advertising materials",),
    ),
    Template(
        "bsd-4-clause",
        _BSD
        + """
3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software
developed by the organization.
4. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission.
""",
        ("all advertising materials mentioning features", "neither the name"),
    ),
    Template(
        "apache-2.0",
        """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy
of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the
License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
""",
        ("apache license version 2 0", "except in compliance with the license"),
    ),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template("gpl-2.0", _gnu("GNU General Public License", "2"), ("gnu general public license", "version 2 of the license")),
    Template("gpl-3.0", _gnu("GNU General Public License", "3"), ("gnu general public license", "version 3 of the license")),
    Template("gpl-2.0", "licensed under the GNU General Public License, version 2", ("gnu general public license version 2",)),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    Template("lgpl-2.1", _gnu("GNU Lesser General Public License", "2.1"), ("gnu lesser general public license", "version 2 1 of the license")),
    Template("lgpl-3.0", _gnu("GNU Lesser General Public License", "3"), ("gnu lesser general public license", "version 3 of the license")),
    Template("agpl-3.0", _gnu("GNU Affero General Public License", "3"), ("gnu affero general public license", "version 3 of the license")),
    Template(
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        ("mozilla public license v 2 0",),
    ),
    Template(
        "epl-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        ("accompanying materials", "eclipse public license 2 0"),
    ),
    Template(
        "cddl-1.0",
        "The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License.",
        ("common development and distribution license",),
    ),
    Template(
        "bsl-1.0",
        """
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to do so.
""",
        ("any person or organization obtaining a copy", "to prepare derivative works of the software"),
    ),
    Template(
        "zlib",
        """
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from
the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented.
""",
        ("permission is granted to anyone to use this software", "the origin of this software must not be misrepresented"),
    ),
    Template(
        "unlicense",
        """
This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
""",
        ("free and unencumbered software released into the public domain",),
    ),
    Template("wtfpl", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION", ("you want to public license",)),
    Template(
        "postgresql",
        """
Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is
hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.
""",
        ("without a written agreement is hereby granted", "the following two paragraphs appear in all copies"),
    ),
    Template("ofl-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is available with a FAQ at", ("sil open font license version 1 1",)),
    Template(
        "cc0-1.0",
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide under the CC0 1.0 Universal Public Domain Dedication.",
        ("to the extent possible under law", "cc0 1 0 universal"),
    ),
    Template("cc-by-4.0", _commons("Attribution"), ("creative commons attribution 4 0",)),
    Template("cc-by-sa-4.0", _commons("Attribution-ShareAlike"), ("creative commons attribution sharealike 4 0",)),
    Template("cc-by-nc-4.0", _commons("Attribution-NonCommercial"), ("creative commons attribution noncommercial 4 0",)),
    Template("cc-by-nd-4.0", _commons("Attribution-NoDerivatives"), ("creative commons attribution noderivatives 4 0",)),
    Template("cc-by-4.0", "licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    Template("cc-by-nc-4.0", "licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template("proprietary", "All rights reserved", ("all rights reserved",)),
)
