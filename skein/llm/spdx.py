"""Licence identifiers by what they ask for, and exceptions. Data of the licence scan; ids are compared in lower case."""

from __future__ import annotations

PERMISSIVE = """
0BSD AAL Abstyles Adobe-2006 Adobe-Glyph ADSL AFL-1.1 AFL-1.2 AFL-2.0 AFL-2.1 AFL-3.0 Afmparse AMDPLPA AML AMPAS ANTLR-PD
ANTLR-PD-fallback Apache-1.0 Apache-1.1 Apache-2.0 APAFML App-s2p Artistic-1.0 Artistic-1.0-cl8 Artistic-1.0-Perl Artistic-2.0
Bahyph Barr Beerware Bitstream-Charter Bitstream-Vera blessing BlueOak-1.0.0 Boehm-GC Borceux Brian-Gladman-3-Clause BSD-1-Clause
BSD-2-Clause BSD-2-Clause-Darwin BSD-2-Clause-Patent BSD-2-Clause-Views BSD-3-Clause BSD-3-Clause-Attribution BSD-3-Clause-Clear
BSD-3-Clause-LBNL BSD-3-Clause-Modification BSD-3-Clause-Open-MPI BSD-4-Clause BSD-4-Clause-Shortened BSD-4-Clause-UC
BSD-4.3RENO BSD-4.3TAHOE BSD-Attribution-HPND-disclaimer BSD-Protection BSD-Source-Code BSL-1.0 bzip2-1.0.6 Caldera CC-BY-1.0
CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-3.0-AT CC-BY-3.0-DE CC-BY-3.0-US CC-BY-4.0 CC-PDDC CC0-1.0 CDLA-Permissive-1.0 CDLA-Permissive-2.0
CECILL-B CFITSIO checkmk ClArtistic CMU-Mach CNRI-Jython CNRI-Python COIL-1.0 Community-Spec-1.0 copyfree-open-innovation
Cornell-Lossless-JPEG Crossword CrystalStacker Cube curl DL-DE-BY-2.0 DOC Dotseqn DRL-1.0 DSDP dvipdfm ECL-1.0 ECL-2.0 EFL-1.0
EFL-2.0 eGenix Entessa EPICS etalab-2.0 EUDatagrid Fair FDK-AAC FreeBSD-DOC FSFAP FSFUL FSFULLR FSFULLRWD FTL GD Giftware GL2PS Glulxe
HaskellReport HP-1986 HPND HPND-sell-variant HTMLTIDY IBM-pibs ICU IJG IJG-short ImageMagick iMatix Info-ZIP Intel Intel-ACPI ISC
ISC-Veillard JasPer-2.0 JPNIC JSON Kazlib Knuth-CTAN Latex2e Leptonica LibTIFF libpng libpng-2.0 libselinux-1.0 libutil-David-Nugent
Linux-OpenIB LOOP LPL-1.0 LPL-1.02 MakeIndex metamail Minpack MirOS MIT MIT-0 MIT-advertising MIT-CMU MIT-enna MIT-feh MIT-Festival
MIT-Modern-Variant MIT-open-group MIT-Wu MITNFA mpich2 mpi-permissive mplus MS-PL MTLL MulanPSL-1.0 MulanPSL-2.0 Multics Mup NAIST-2003
NBPL-1.0 NCSA Net-SNMP NetCDF Newsletr NICTA-1.0 NIST-PD NIST-PD-fallback NLOD-1.0 NLOD-2.0 NLPL Noweb NRL NTP NTP-0 ODC-By-1.0 OFFIS
OGC-1.0 OGDL-Taiwan-1.0 OGL-Canada-2.0 OGL-UK-1.0 OGL-UK-2.0 OGL-UK-3.0 OGTSL OLDAP-2.0 OLDAP-2.8 OML OpenPBS-2.3 OpenSSL OPUBL-1.0
PDDL-1.0 PHP-3.0 PHP-3.01 Plexus PostgreSQL PSF-2.0 psfrag psutils Python-2.0 Python-2.0.1 Qhull Rdisc RSA-MD Ruby Saxpath SCEA
SchemeReport Sendmail SGI-B-1.1 SGI-B-2.0 SHL-0.5 SHL-0.51 SMLNJ snprintf softSurfer SSH-OpenSSH SSH-short StandardML-NJ Sun-PPP SunPro
SWL TCL TCP-wrappers TMate TOSL TPDL TTWL TU-Berlin-1.0 TU-Berlin-2.0 UCAR UCL-1.0 Unicode-3.0 Unicode-DFS-2015 Unicode-DFS-2016
Unicode-TOU Unlicense UPL-1.0 Vim VSL-1.0 W3C W3C-19980720 W3C-20150513 w3m Wsuipa WTFPL X11 X11-distribute-modifications-variant Xdebug-1.03
Xerox Xfig XFree86-1.1 xinetd xlock Xnet xpp XSkat Zed Zend-2.0 Zimbra-1.3 Zimbra-1.4 Zlib zlib-acknowledgement ZPL-1.1 ZPL-2.0 ZPL-2.1
"""

WEAK = """
APSL-1.0 APSL-1.1 APSL-1.2 APSL-2.0 BitTorrent-1.0 BitTorrent-1.1 CATOSL-1.1 CDDL-1.0 CDDL-1.1 CDL-1.0 CDLA-Sharing-1.0 CECILL-C
CERN-OHL-W-2.0 Condor-1.1 CPAL-1.0 CPL-1.0 CUA-OPL-1.0 EPL-1.0 EPL-2.0 ErlPL-1.1 Frameworx-1.0 gSOAP-1.3b Interbase-1.0 IPL-1.0
LGPL-2.0 LGPL-2.0+ LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1+ LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0+
LGPL-3.0-only LGPL-3.0-or-later LGPLLR LPPL-1.0 LPPL-1.1 LPPL-1.2 LPPL-1.3a LPPL-1.3c MPL-1.0 MPL-1.1 MPL-2.0
MPL-2.0-no-copyleft-exception MS-RL Motosoto Naumen NASA-1.3 Nokia NOSL NPL-1.0 NPL-1.1 OCLC-2.0 OFL-1.0 OFL-1.0-no-RFN OFL-1.0-RFN
OFL-1.1 OFL-1.1-no-RFN OFL-1.1-RFN OSET-PL-2.1 PolyForm-Perimeter-1.0.0 RHeCos-1.1 RPSL-1.0 RSCPL SISSL SISSL-1.2 SNIA SPL-1.0
SugarCRM-1.1.3 Watcom-1.0 wxWindows YPL-1.0 YPL-1.1 Arphic-1999
"""

STRONG = """
AGPL-1.0 AGPL-1.0-only AGPL-1.0-or-later AGPL-3.0 AGPL-3.0+ AGPL-3.0-only AGPL-3.0-or-later CC-BY-SA-1.0 CC-BY-SA-2.0 CC-BY-SA-2.5
CC-BY-SA-3.0 CC-BY-SA-3.0-AT CC-BY-SA-3.0-DE CC-BY-SA-4.0 CECILL-1.0 CECILL-1.1 CECILL-2.0 CECILL-2.1 CERN-OHL-S-2.0 copyleft-next-0.3.0
copyleft-next-0.3.1 EUPL-1.0 EUPL-1.1 EUPL-1.2 FreeImage GFDL-1.1 GFDL-1.1-only GFDL-1.1-or-later GFDL-1.2 GFDL-1.2-only
GFDL-1.2-or-later GFDL-1.3 GFDL-1.3-only GFDL-1.3-or-later GPL-1.0 GPL-1.0+ GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0+ GPL-2.0-only
GPL-2.0-or-later GPL-3.0 GPL-3.0+ GPL-3.0-only GPL-3.0-or-later LAL-1.2 LAL-1.3 LiLiQ-P-1.1 LiLiQ-R-1.1 LiLiQ-Rplus-1.1 NGPL
ODbL-1.0 OSL-1.0 OSL-1.1 OSL-2.0 OSL-2.1 OSL-3.0 Parity-6.0.0 Parity-7.0.0 QPL-1.0 RPL-1.1 RPL-1.5 SimPL-2.0 Sleepycat SSPL-1.0
TAPR-OHL-1.0 Vim-copyleft
"""

RESTRICTED = """
Aladdin BUSL-1.1 CC-BY-NC-1.0 CC-BY-NC-2.0 CC-BY-NC-2.5 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-1.0 CC-BY-NC-ND-2.0 CC-BY-NC-ND-2.5
CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-1.0 CC-BY-NC-SA-2.0 CC-BY-NC-SA-2.5 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-ND-1.0
CC-BY-ND-2.0 CC-BY-ND-2.5 CC-BY-ND-3.0 CC-BY-ND-4.0 Elastic-2.0 Hippocratic-2.1 JPL-image NCGL-UK-2.0 PolyForm-Noncommercial-1.0.0
PolyForm-Small-Business-1.0.0 BSD-3-Clause-No-Nuclear-License BSD-3-Clause-No-Nuclear-License-2014 BSD-3-Clause-No-Nuclear-Warranty
C-UDA-1.0 CAL-1.0 CAL-1.0-Combined-Work-Exception NLOD-NC
"""

#: What each lets programs do that a licence of strong copyleft alone would not.
EXCEPTIONS = frozenset(x.lower() for x in """
389-exception Asterisk-exception Autoconf-exception-2.0 Autoconf-exception-3.0 Autoconf-exception-generic Autoconf-exception-macro
Bison-exception-1.24 Bison-exception-2.2 Bootloader-exception Classpath-exception-2.0 CLISP-exception-2.0 cryptsetup-OpenSSL-exception
DigiRule-FOSS-exception eCos-exception-2.0 Fawkes-Runtime-exception FLTK-exception Font-exception-2.0 freertos-exception-2.0
GCC-exception-2.0 GCC-exception-3.1 GNAT-exception gnu-javamail-exception GPL-3.0-linking-exception GPL-3.0-linking-source-exception
GPL-CC-1.0 GStreamer-exception-2005 GStreamer-exception-2008 i2p-gpl-java-exception KiCad-libraries-exception LGPL-3.0-linking-exception
libpri-OpenH323-exception Libtool-exception Linux-syscall-note LLGPL LLVM-exception LZMA-exception mif-exception Nokia-Qt-exception-1.1
OCaml-LGPL-linking-exception OCCT-exception-1.0 OpenJDK-assembly-exception-1.0 openvpn-openssl-exception PS-or-PDF-font-exception-20170817
Qt-GPL-exception-1.0 Qt-LGPL-exception-1.1 Qwt-exception-1.0 SHL-2.0 SHL-2.1 Swift-exception u-boot-exception-2.0
Universal-FOSS-exception-1.0 vsftpd-openssl-exception WxWindows-exception-3.1 x11vnc-openssl-exception
""".split())  # fmt: skip
