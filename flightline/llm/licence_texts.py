"""Passages by which files state a licence: statements, headers, whole short licences and the opening words of long ones.  Fixed values."""

_WARRANTY = """This software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to, the
implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct,
indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or
profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise)
arising in any way out of the use of this software, even if advised of the possibility of such damage."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution."""
_ENDORSE = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission."""
_GNU = """This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation;
either version {version} of the License, or (at your option) any later version."""
_COPIES = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."


def _gnu(what: str, kind: str, version: str) -> str:
    return _GNU.format(what=what, kind=kind, version=version)


PASSAGES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
License at http://www.apache.org/licenses/LICENSE-2.0""",
        """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License"
shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.""",
    ),
    "BSD-2-Clause": (f"{_BSD} {_WARRANTY}", "Licensed under the BSD 2-Clause License."),
    "BSD-3-Clause": (f"{_BSD} {_ENDORSE} {_WARRANTY}", "Licensed under the BSD 3-Clause License.",
                     "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.",
                  "Creative Commons Attribution 4.0 International Public License By exercising the Licensed Rights"),
    "CC-BY-NC-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
                     "Creative Commons Attribution-NonCommercial 4.0 International Public License By exercising the Licensed Rights"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
                     "Creative Commons Attribution-ShareAlike 4.0 International Public License By exercising the Licensed Rights"),
    "CC0-1.0": ("""Creative Commons Legal Code CC0 1.0 Universal Creative Commons Corporation is not a law firm and does not provide legal services. Distribution of this
document does not create an attorney-client relationship.""",),
    "GPL-2.0": (
        _gnu("program", "General Public License", "2"), "Licensed under the GNU General Public License, version 2.",
        f"GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA {_COPIES} "
        "Preamble The licenses for most software are designed to take away your freedom to share and change it.",
    ),
    "GPL-3.0": (
        _gnu("program", "General Public License", "3"),
        f"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> {_COPIES} "
        "Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    ),
    "LGPL-2.1": (
        _gnu("library", "Lesser General Public License", "2.1"), "Licensed under the GNU Lesser General Public License, version 2.1.",
        f"GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA {_COPIES} "
        "[This is the first released version of the Lesser GPL.",
    ),
    "LGPL-3.0": (
        _gnu("library", "Lesser General Public License", "3"), "Licensed under the GNU Lesser General Public License, version 3.",
        f"GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> {_COPIES} "
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    ),
    "MIT": (
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the
Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE.""",
        "Licensed under the MIT License.",
    ),
    "MPL-2.0": (
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
http://mozilla.org/MPL/2.0/.""",
        """Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns
Covered Software.""",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
}
