"""Wordings of public licenses as templates (see ``licenses``).

Short licenses stand in full.  Of the long ones the parts stand that name and
open them (title, preamble, grant), each as one template; any of them labels a
text.  Numbers of clauses and bullets are optional, names are replaceable.
"""

_DISCLAIMER = """this software is provided by {{holder}} as is and any express or implied warranties including but not limited to
    the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{holder}}
    be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to
    procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any
    theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out
    of the use of this software even if advised of the possibility of such damage"""
_USE = """redistribution and use in source and binary forms with or without modification are permitted provided that the following
    conditions are met"""
_SOURCE = """[[{{n|1|a|i}}]] redistributions of source code must retain the above copyright notice this list of conditions and the
    following disclaimer"""
_BINARY = """[[{{n|2|b|ii}}]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the
    following disclaimer in the documentation and or other materials provided with the distribution"""
_NAMES = """[[{{n|3|4|c|iii}}]] neither the name of {{holder}} nor the names of its contributors may be used to endorse or promote products
    derived from this software without specific prior written permission"""
_ADVERTS = """[[{{n|3|c|iii}}]] all advertising materials mentioning features or use of this software must display the following
    acknowledgement this product includes software developed by {{holder}}"""
_MIT_GRANT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation
    files the software to deal in the software without restriction including without limitation the rights to use copy modify
    merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is
    furnished to do so"""
_MIT_NOTICE = """subject to the following conditions the above copyright notice and this permission notice
    [[including the next paragraph]] shall be included in all copies or substantial portions of the software"""
_MIT_WARRANTY = """the software is provided as is without warranty of any kind express or implied including but not limited to the
    warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {{holders}} be liable
    for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in
    connection with the software or the use or other dealings in the software"""
_ISC_WARRANTY = """the software is provided as is and {{holder}} disclaims all warranties with regard to this software including all implied
    warranties of merchantability and fitness in no event shall {{holder}} be liable for any special direct indirect or
    consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract
    negligence or other tortious action arising out of or in connection with the use or performance of this software"""

FULL = (
    ("mit", f"{_MIT_GRANT} {_MIT_NOTICE} [[{_MIT_WARRANTY}]]"),
    ("mit-0", f"{_MIT_GRANT} {_MIT_WARRANTY}"),
    ("x11", f"""{_MIT_GRANT} {_MIT_NOTICE} {_MIT_WARRANTY} except as contained in this notice the name of {{{{holder}}}} shall not be used in
        advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization
        from {{{{holder}}}}"""),
    ("bsd-1", f"{_USE} {_SOURCE} {_DISCLAIMER}"),
    ("bsd-2", f"{_USE} {_SOURCE} {_BINARY} {_DISCLAIMER}"),
    ("bsd-3", f"{_USE} {_SOURCE} {_BINARY} {_NAMES} {_DISCLAIMER}"),
    ("bsd-4", f"{_USE} {_SOURCE} {_BINARY} {_ADVERTS} {_NAMES} {_DISCLAIMER}"),
    ("isc", f"""permission to use copy modify and {{{{or|and or|or}}}} distribute this software for any purpose with or without fee is hereby
        granted provided that the above copyright notice and this permission notice appear in all copies [[{_ISC_WARRANTY}]]"""),
    ("0bsd", f"""permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
        {_ISC_WARRANTY}"""),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any
        damages arising from the use of this software permission is granted to anyone to use this software for any purpose
        including commercial applications and to alter it and redistribute it freely subject to the following restrictions
        [[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you
        use this software in a product an acknowledgment in the product documentation would be appreciated but is not required
        [[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software
        [[3]] this notice may not be removed or altered from any source distribution"""),
    ("bsl-1", """permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying
        documentation covered by this license the software to use reproduce display distribute execute and transmit the software
        and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all
        subject to the following the copyright notices in the software and this entire statement including the above license grant
        this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all
        derivative works of the software unless such copies or derivative works are solely in the form of machine executable object
        code generated by a source language processor the software is provided as is without warranty of any kind express or implied
        including but not limited to the warranties of merchantability fitness for a particular purpose title and non infringement in
        no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability whether
        in contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the
        software"""),
    ("unlicense", f"""this is free and unencumbered software released into the public domain [[anyone is free to copy modify publish use compile
        sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non
        commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate
        any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at
        large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in
        perpetuity of all present and future rights to this software under copyright law {_MIT_WARRANTY}]]"""),
    ("wtfpl", """do what the fuck you want to public license [[version 2 december 2004]] [[copyright c {{year}}]] everyone is permitted to copy and
        distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed
        [[do what the fuck you want to public license]] terms and conditions for copying distribution and modification 0 you just do
        what the fuck you want to"""),
    ("beerware", """{{name}} wrote this file as long as you retain this notice you can do whatever you want with this stuff if we meet some day
        and you think this stuff is worth it you can buy me a beer in return"""),
    ("postgresql", """permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a
        written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two
        paragraphs appear in all copies in no event shall {{holder}} be liable to any party for direct indirect special incidental or
        consequential damages including lost profits arising out of the use of this software and its documentation even if {{holder}}
        has been advised of the possibility of such damage {{holder}} specifically disclaims any warranties including but not limited
        to the implied warranties of merchantability and fitness for a particular purpose the software provided hereunder is on an as
        is basis and {{holder}} has no obligations to provide maintenance support updates enhancements or modifications"""),
    ("ntp", """permission to use copy modify and distribute this software and its documentation for any purpose {{fee|with or without|without}}
        fee is hereby granted provided that the above copyright notice appears in all copies and that both the copyright notice and
        this permission notice appear in supporting documentation and that the name {{holder}} not be used in advertising or publicity
        pertaining to distribution of the software without specific written prior permission {{holder}} makes no representations about
        the suitability this software for any purpose it is provided as is without express or implied warranty"""),
    ("ncsa", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
        the software to deal with the software without restriction including without limitation the rights to use copy modify merge
        publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to
        do so subject to the following conditions [[{{n|1}}]] redistributions of source code must retain the above copyright notice this
        list of conditions and the following disclaimers [[{{n|2}}]] redistributions in binary form must reproduce the above copyright
        notice this list of conditions and the following disclaimers in the documentation and or other materials provided with the
        distribution [[{{n|3}}]] neither the names of {{holder}} nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission"""),
    ("curl", """permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that
        the above copyright notice and this permission notice appear in all copies the software is provided as is without warranty of
        any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose
        and noninfringement of third party rights in no event shall the authors or copyright holders be liable for any claim damages or
        other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or
        the use or other dealings in the software except as contained in this notice the name of a copyright holder shall not be used
        in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization of
        the copyright holder"""),
    ("fsfap", """copying and distribution of this file with or without modification are permitted in any medium without royalty provided the
        copyright notice and this notice are preserved [[this file is offered as is without any warranty]]"""),
    ("fair", """usage of the works is permitted provided that this instrument is retained with the works so that any entity that uses the works
        is notified of this instrument disclaimer the works are without warranty"""),
    ("ofl-1.1", """permission is hereby granted free of charge to any person obtaining a copy of the font software to use study copy merge embed
        modify redistribute and sell modified and unmodified copies of the font software subject to the following conditions
        [[1]] neither the font software nor any of its individual components in original or modified versions may be sold by itself"""),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1"),
    ("apache-2", """subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive
        no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform
        sublicense and distribute the work and such derivative works in source or object form [[3]] grant of patent license subject to
        the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge
        royalty free irrevocable except as stated in this section patent license to make have made use offer to sell sell import and
        otherwise transfer the work where such license applies only to those patent claims licensable by such contributor that are
        necessarily infringed by their contribution s alone or by combination of their contribution s with the work to which such
        contribution s was submitted"""),
    ("apache-2", """[[you may not use this file except in compliance with the license you may obtain a copy of the license at {{place}}]] unless
        required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
        without warranties or conditions of any kind either express or implied see the license for the specific language governing
        permissions and limitations under the license"""),
    ("gpl-3", """gnu general public license version 3 29 june 2007 [[copyright {{holder}}]] everyone is permitted to copy and distribute verbatim copies
        of this license document but changing it is not allowed preamble the gnu general public license is a free copyleft license for
        software and other kinds of works"""),
    ("gpl-2", """gnu general public license version 2 june 1991 [[copyright {{holder}}]] [[{{address}}]] everyone is permitted to copy and distribute
        verbatim copies of this license document but changing it is not allowed preamble the licenses for most software are designed to
        take away your freedom to share and change it"""),
    ("lgpl-3", """gnu lesser general public license version 3 29 june 2007 [[copyright {{holder}}]] everyone is permitted to copy and distribute
        verbatim copies of this license document but changing it is not allowed this version of the gnu lesser general public license
        incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions
        listed below"""),
    ("lgpl-2.1", """gnu lesser general public license version 2 1 february 1999 [[copyright {{holder}}]] [[{{address}}]] everyone is permitted to copy
        and distribute verbatim copies of this license document but changing it is not allowed"""),
    ("agpl-3", """gnu affero general public license version 3 19 november 2007 [[copyright {{holder}}]] everyone is permitted to copy and distribute
        verbatim copies of this license document but changing it is not allowed preamble the gnu affero general public license is a free
        copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the
        case of network server software"""),
    ("mpl-2", """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with
        this file you can obtain one at {{place}}"""),
    ("mpl-2", "mozilla public license version 2 0 [[1]] definitions [[1 1]] contributor means each individual or legal entity that creates contributes to the creation of or owns covered software"),
    ("epl-2", """the accompanying program is provided under the terms of this eclipse public license agreement any use reproduction or
        distribution of the program constitutes recipient s acceptance of this agreement"""),
    ("epl-2", "{{verb|licensed|available|made available}} under the [[terms of the]] eclipse public license [[version]] [[v]] {{v|2 0|2}}"),
    ("cc-by", """by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative
        commons attribution 4 0 international public license public license"""),
    ("cc-by-sa", """by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative
        commons attribution sharealike 4 0 international public license public license"""),
    ("cc-by-nc", """by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative
        commons attribution noncommercial 4 0 international public license public license"""),
    ("cc0", """the laws of most jurisdictions throughout the world automatically confer exclusive copyright and related rights defined below upon
        the creator and subsequent owner s each and all an owner of an original work of authorship and or a database each a work"""),
)
