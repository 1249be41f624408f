"""Tables that the SQL side has of its own: nothing here is read by the operators, nor taken from them."""

#: Colour names and their 8-bit channels, of every kind of name: plain, in two spellings, numbered, by percent, unknown.
NAMED = {
    "red": (255, 0, 0), "blue": (0, 0, 255), "antiquewhite1": (255, 239, 219), "antiquewhite4": (139, 131, 120), "khaki3": (205, 198, 115), "hotpink4": (139, 58, 98), "slate grey": (112, 128, 144),
    "dodgerblue2": (28, 134, 238), "tan4": (139, 90, 43), "medium purple": (147, 112, 219), "purple2": (145, 44, 238), "azure3": (193, 205, 205), "peru": (205, 133, 63), "goldenrod3": (205, 155, 29),
    "chocolate4": (139, 69, 19), "gray37": (94, 94, 94), "grey99": (252, 252, 252), "gray5": (13, 13, 13), "lightgoldenrodyellow": (250, 250, 210), "cornsilk3": (205, 200, 177), "thistle2": (238, 210, 238),
}
UNKNOWN = ("gray101", "azure5", "no such colour")

#: Halftone cells from black to white, four rows of four bits each.
CELLS = "ffff efff efbf afbf afaf adaf ada7 a5a7 a5a5 85a5 8525 0525 0505 0405 0401 0001 0000"

#: Flags in their order.
FLAGS = """
    debug dumpcore default delay display dispgamma fillscreen fit forall fork fullscreen geometry goto help identify install list onroot path pixmap
    private quiet supported verbose version view visual windowid cache delete focus at background border brighten center clip colordither cdither colors
    dither expand foreground gamma gray grey halftone idelay invert iscale merge name newoptions normalize rotate smooth title xpm xzoom yzoom zoom
"""

#: Satellite sensors: code and name, a line each.
SENSORS = """
0 Non-Image Derived Data
1 Test patterns
2 Graphics
3 Miscellaneous
4 PDUS Meteosat Visible
5 PDUS Meteosat Infrared
6 PDUS Meteosat Water Vapor
7 Radar
8 Miscellaneous Aircraft Data (MAMS)
12 GMS Visible
13 GMS Infrared
14 ATS 6 Visible
15 ATS 6 Infrared
16 SMS-1 Visible
17 SMS-1 Infrared
18 SMS-2 Visible
19 SMS-2 Infrared
20 GOES-1 Visible
21 GOES-1 Infrared
22 GOES-2 Visible
23 GOES-2 Infrared
24 GOES-3 Visible
25 GOES-3 Infrared
26 GOES-4 Visible (VAS)
27 GOES-4 Infrared and Water Vapor (VAS)
28 GOES-5 Visible (VAS)
29 GOES-5 Infrared and Water Vapor (VAS)
30 GOES-6 Visible
31 GOES-6 Infrared
32 GOES-Visible, Block 1 Auxiliary Data
33 GOES-7 Infrared
34 NOAA Series Satellites
36 NOAA Series Satellites
37 NOAA Series Satellites
38 NOAA Series Satellites
39 NOAA Series Satellites
40 NOAA Series Satellites
41 TIROS-N
42 NOAA-6
43 NOAA-7
44 NOAA-8
45 NOAA-9
46 Venus
47 Voyager 1
48 Voyager 2
50 Hubble St.
60 NOAA-10
61 NOAA-11
70 GOES-I (IMAGER)
71 GOES-I (SOUNDER)
72 GOES-J (IMAGER)
73 GOES-J (SOUNDER)
74 GOES-K (IMAGER)
75 GOES-K (SOUNDER)
76 GOES-L (IMAGER)
77 GOES-L (SOUNDER)
78 GOES-M (IMAGER)
79 GOES-M (SOUNDER)
80 ERBE
90 RAW METEOSAT
"""
