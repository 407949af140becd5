"""The templates of licences, whole texts and the notices that point to them.

Of each: its words, the key phrases that must stand in it, and phrases that must not. Case, marks and line ends don't matter.
"""

from __future__ import annotations

from typing import NamedTuple


class Template(NamedTuple):
    text: str
    keys: tuple[str, ...]
    without: tuple[str, ...] = ()


_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific
prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product
documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This
notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in
source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this
software dedicate any and all copyright interest in the software to the public domain."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the
"Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software
is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following
disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of
machine-executable object code generated by a source language processor."""


def _gnu(kind: str, version: str) -> str:
    return f"""This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, either version {version}
of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details."""


_GPL, _LGPL, _AGPL = "General Public License", "Lesser General Public License", "Affero General Public License"
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
http://mozilla.org/MPL/2.0/."""


def _cc(kind: str, name: str) -> list[Template]:
    return [
        Template(f"licensed under cc {kind} 4 0", (f"under cc {kind} 4 0",)),
        Template(f"this work is licensed under a creative commons attribution {name} 4 0 international license", (f"creative commons attribution {name} 4 0".replace("  ", " "),)),
    ]


TEMPLATES: dict[str, list[Template]] = {
    "apache-2.0": [Template(_APACHE, ("licensed under the apache license version 2 0", "except in compliance with the license")), Template("licensed under the apache license version 2 0", ("the apache license version 2 0",))],
    "mit": [Template(_MIT, ("permission is hereby granted free of charge to any person obtaining a copy", "the software is provided as is")), Template("released under the mit license", ("under the mit license",)), Template("licensed under the mit license", ("under the mit license",))],
    "bsd-2-clause": [Template(f"{_BSD_HEAD} {_BSD_TAIL}", ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce"), ("to endorse or promote products",))],
    "bsd-3-clause": [Template(f"{_BSD_HEAD} {_BSD_THIRD} {_BSD_TAIL}", ("redistribution and use in source and binary forms", "to endorse or promote products"))],
    "bsd": [Template("redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)), Template("licensed under the bsd license", ("under the bsd license",))],
    "isc": [Template(_ISC, ("copy modify and or distribute this software for any purpose", "notice appear in all copies")), Template("released under the isc license", ("under the isc license",))],
    "0bsd": [Template(_ISC.replace(", provided that the above copyright notice and this\npermission notice appear in all copies", ""), ("copy modify and or distribute this software for any purpose",), ("notice appear in all copies",))],
    "zlib": [Template(_ZLIB, ("the origin of this software must not be misrepresented", "altered source versions must be plainly marked"))],
    "bsl-1.0": [Template(_BOOST, ("to any person or organization obtaining a copy of the software",)), Template("distributed under the boost software license version 1 0", ("the boost software license version 1 0",))],
    "unlicense": [Template(_UNLICENSE, ("unencumbered software released into the public domain",))],
    "gpl-2.0": [Template(_gnu(_GPL, "2"), ("the gnu general public license as published", "either version 2")), Template("gnu general public license version 2", ("gnu general public license version 2",))],
    "gpl-3.0": [Template(_gnu(_GPL, "3"), ("the gnu general public license as published", "either version 3")), Template("gnu general public license version 3", ("gnu general public license version 3",))],
    "lgpl": [Template(_gnu(_LGPL, "2 1"), ("the gnu lesser general public license as published",)), Template("licensed under the gnu lesser general public license", ("under the gnu lesser general public license",))],
    "agpl-3.0": [Template(_gnu(_AGPL, "3"), ("the gnu affero general public license as published",)), Template("gnu affero general public license version 3", ("gnu affero general public license version 3",))],
    "mpl-2.0": [Template(_MPL, ("the terms of the mozilla public license v 2 0",))],
    "cc0-1.0": [Template("dedicated to the public domain under cc0 1 0 universal", ("cc0 1 0 universal",))],
    "cc-by-4.0": _cc("by", ""),
    "cc-by-sa-4.0": _cc("by sa", "sharealike"),
    "cc-by-nc-4.0": _cc("by nc", "noncommercial"),
    "cc-by-nd-4.0": _cc("by nd", "noderivatives"),
    "proprietary": [Template("this software is proprietary and confidential unauthorized copying is strictly prohibited", ("proprietary and confidential", "unauthorized copying"))],
}
