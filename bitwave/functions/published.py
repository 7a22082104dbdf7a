"""Published tables of the format that have no rule: the larger pair codes and the synthesis window."""

#: Codes by table: a row for each x with the codes of y = 0, 1, ... Tables 16 and 24 serve all to 23 and 31.
LARGE_CODES = {
    7: (
        "1 010 001010 00010011 00010000 000001010",
        "011 0011 000111 0001010 0000101 00000011",
        "001011 00100 0001101 00010001 00001000 000000100",
        "0001100 0001011 00010010 000001111 000001011 000000010",
        "0000111 0000110 00001001 000001110 000000011 0000000001",
        "00000110 00000100 000000101 0000000011 0000000010 0000000000",
    ),
    8: (
        "11 100 000110 00010010 00001100 000000101",
        "101 01 0010 00010000 00001001 00000011",
        "000111 0011 000101 00001110 00000111 000000011",
        "00010011 00010001 00001111 000001101 000001010 0000000100",
        "00001101 0000101 00001000 000001011 0000000101 0000000001",
        "000001100 00000100 000000100 000000001 00000000001 00000000000",
    ),
    9: (
        "111 101 01001 001110 00001111 000000111",
        "110 100 0101 00101 000110 00000111",
        "0111 0110 01000 001000 0001000 00000101",
        "001111 00110 001001 0001010 0000101 00000001",
        "0001011 000111 0001001 0000110 00000100 000000001",
        "00001110 0000100 00000110 00000010 000000110 000000000",
    ),
    10: (
        "1 010 001010 00010111 000100011 000011110 000001100 0000010001",
        "011 0011 001000 0001100 00010010 000010101 00001100 00000111",
        "001011 001001 0001111 00010101 000100000 0000101000 000010011 000000110",
        "0001110 0001101 00010110 000100010 0000101110 0000010111 000010010 0000000111",
        "00010100 00010011 000100001 0000101111 0000011011 0000010110 0000001001 0000000011",
        "000011111 000010110 0000101001 0000011010 00000010101 00000010100 0000000101 00000000011",
        "00001110 00001101 000001010 0000001011 0000010000 0000000110 00000000101 00000000001",
        "000001001 00001000 000000111 0000001000 0000000100 00000000100 00000000010 00000000000",
    ),
    11: (
        "11 100 01010 0011000 00100010 000100001 00010101 000001111",
        "101 011 0100 001010 00100000 00010001 0001011 00001010",
        "01011 00111 001101 0010010 00011110 000011111 00010100 00000101",
        "0011001 001011 0010011 000111011 00011011 0000010010 00001100 000000101",
        "00100011 00100001 00011111 000111010 000011110 0000010000 000000111 0000000101",
        "00011100 00011010 000100000 0000010011 0000010001 00000001111 0000001000 00000001110",
        "00001110 0001100 0001001 00001101 000001110 0000001001 0000000100 0000000001",
        "00001011 0000100 00000110 000000110 0000000110 0000000011 0000000010 0000000000",
    ),
    12: (
        "1001 110 10000 0100001 00101001 000100111 000100110 000011010",
        "111 101 0110 01001 0010111 0010000 00011010 00001011",
        "10001 0111 01011 001110 0010101 00011110 0001010 00000111",
        "010001 01010 001111 001100 0010010 00011100 00001110 00000101",
        "0100000 001101 0010110 0010011 00010010 00010000 00001001 000000101",
        "00101000 0010001 00011111 00011101 00010001 000001101 00000100 000000010",
        "00011011 0001100 0001011 00001111 00001010 000000111 000000100 0000000001",
        "000011011 00001100 00001000 000001100 000000110 000000011 000000001 0000000000",
    ),
    13: (
        "1 0101 001110 0010101 00100010 000110011 000101110 0001000111 000101010 0000110100 00001000100 00000110100 000001000011 000000101100 0000000101011 0000000010011",
        "011 0100 001100 0010011 00011111 00011010 000101100 000100001 000011111 000011000 0000100000 0000011000 00000011111 000000100011 000000010110 000000001110",
        "001111 001101 0010111 00100100 000111011 000110001 0001001101 0001000001 000011101 0000101000 0000011110 00000101000 00000011011 000000100001 0000000101010 0000000010000",
        "0010110 0010100 00100101 000111101 000111000 0001001111 0001001001 0001000000 0000101011 00001001100 00000111000 00000100101 00000011010 000000011111 0000000011001 0000000001110",
        "00100011 0010000 000111100 000111001 0001100001 0001001011 00001110010 00001011011 0000110110 00001001001 00000110111 000000101001 000000110000 0000000110101 0000000010111 00000000011000",
        "000111010 00011011 000110010 0001100000 0001001100 0001000110 00001011101 00001010100 00001001101 00000111010 000001001111 00000011101 0000001001010 0000000110001 00000000101001 00000000010001",
        "000101111 000101101 0001001110 0001001010 00001110011 00001011110 00001011010 00001001111 00001000101 000001010011 000001000111 000000110010 0000000111011 0000000100110 00000000100100 00000000001111",
        "0001001000 000100010 0000111000 00001011111 00001011100 00001010101 000001011011 000001011010 000001010110 000001001001 0000001001101 0000001000001 0000000110011 00000000101100 0000000000101011 0000000000101010",
        "000101011 00010100 000011110 0000101100 0000110111 00001001110 00001001000 000001010111 000001001110 000000111101 000000101110 0000000110110 0000000100101 00000000011110 000000000010100 000000000010000",
        "0000110101 000011001 0000101001 0000100101 00000101100 00000111011 00000110110 0000001010001 000001000010 0000001001100 0000000111001 00000000110110 00000000100101 00000000010010 0000000000100111 000000000001011",
        "0000100011 0000100001 0000011111 00000111001 00000101010 000001010010 000001001000 0000001010000 000000101111 0000000111010 00000000110111 0000000010101 00000000010110 000000000011010 0000000000100110 00000000000010110",
        "00000110101 0000011001 0000010111 00000100110 000001000110 000000111100 000000110011 000000100100 0000000110111 0000000011010 0000000100010 00000000010111 000000000011011 000000000001110 000000000001001 0000000000000111",
        "00000100010 00000100000 00000011100 000000100111 000000110001 0000001001011 000000011110 0000000110100 00000000110000 00000000101000 000000000110100 000000000011100 000000000010010 0000000000010001 0000000000001001 0000000000000101",
        "000000101101 00000010101 000000100010 0000001000000 0000000111000 0000000110010 00000000110001 00000000101101 00000000011111 00000000010011 00000000001100 000000000001111 0000000000001010 000000000000111 0000000000000110 0000000000000011",
        "0000000110000 000000010111 000000010100 0000000100111 0000000100100 0000000100011 000000000110101 00000000010101 00000000010000 00000000000010111 000000000001101 000000000001010 000000000000110 00000000000000001 0000000000000100 0000000000000010",
        "000000010000 000000001111 0000000010001 00000000011011 00000000011001 00000000010100 000000000011101 00000000001011 000000000010001 000000000001100 0000000000010000 0000000000001000 0000000000000000001 000000000000000001 0000000000000000000 0000000000000001",
    ),
    15: (
        "111 1100 10010 0110101 0101111 01001100 001111100 001101100 001011001 0001111011 0001101100 00001110111 00001101011 00001010001 000001111010 0000000111111",
        "1101 101 10000 011011 0101110 0100100 00111101 00110011 00101010 001000110 000110100 0001010011 0001000001 0000101001 00000111011 00000100100",
        "10011 10001 01111 011000 0101001 0100010 00111011 00110000 00101000 001000000 000110010 0001001110 0000111110 00001010000 00000111000 00000100001",
        "011101 011100 011001 0101011 0100111 00111111 00110111 001011101 001001100 000111011 0001011101 0001001000 0000110110 00001001011 00000110010 00000011101",
        "0110100 010110 0101010 0101000 01000011 00111001 001011111 001001111 001001000 000111001 0001011001 0001000101 0000110001 00001000010 00000101110 00000011011",
        "01001101 0100101 0100011 01000010 00111010 00110100 001011011 001001010 000111110 000110000 0001001111 0000111111 00001011010 00000111110 00000101000 000000100110",
        "001111101 0100000 00111100 00111000 00110010 001011100 001001110 001000001 000110111 0001010111 0001000111 0000110011 00001001001 00000110011 000001000110 000000011110",
        "001101101 00110101 00110001 001011110 001011000 001001011 001000010 0001111010 0001011011 0001001001 0000111000 0000101010 00001000000 00000101100 00000010101 000000011001",
        "001011010 00101011 00101001 001001101 001001001 000111111 000111000 0001011100 0001001101 0001000010 0000101111 00001000011 00000110000 000000110101 000000100100 000000010100",
        "001000111 00100010 001000011 000111100 000111010 000110001 0001011000 0001001100 0001000011 00001101010 00001000111 00000110110 00000100110 000000100111 000000010111 000000001111",
        "0001101101 000110101 000110011 000101111 0001011010 0001010010 0000111010 0000111001 0000110000 00001001000 00000111001 00000101001 00000010111 000000011011 0000000111110 000000001001",
        "0001010110 000101010 000101000 000100101 0001000110 0001000000 0000110100 0000101011 00001000110 00000110111 00000101010 00000011001 000000011101 000000010010 000000001011 0000000001011",
        "00001110110 0001000100 000011110 0000110111 0000110010 0000101110 00001001010 00001000001 00000110001 00000100111 00000011000 00000010000 000000010110 000000001101 0000000001110 0000000000111",
        "00001011011 0000101100 0000100111 0000100110 0000100010 00000111111 00000110100 00000101101 00000011111 000000110100 000000011100 000000010011 000000001110 000000001000 0000000001001 0000000000011",
        "000001111011 00000111100 00000111010 00000110101 00000101111 00000101011 00000100000 00000010110 000000100101 000000011000 000000010001 000000001100 0000000001111 0000000001010 000000000010 0000000000001",
        "000001000111 00000100101 00000100010 00000011110 00000011100 00000010100 00000010001 000000011010 000000010101 000000010000 000000001010 000000000110 0000000001000 0000000000110 0000000000010 0000000000000",
    ),
    16: (
        "1 0101 001110 00101100 001001010 000111111 0001101110 0001011101 00010101100 00010010101 00010001010 000011110010 000011100001 000011000011 0000101111000 000010001",
        "011 0100 001100 0010100 00100011 000111110 000110101 000101111 0001010011 0001001011 0001000100 00001110111 000011001001 00001101011 000011001111 00001001",
        "001111 001101 0010111 00100110 001000011 000111010 0001100111 0001011010 00010100001 0001001000 00001111111 00001110101 00001101110 000011010001 000011001110 000010000",
        "00101101 0010101 00100111 001000101 001000000 0001110010 0001100011 0001010111 00010011110 00010001100 000011111100 000011010100 000011000111 0000110000011 0000101101101 0000011010",
        "001001011 00100100 001000100 001000001 0001110011 0001100101 00010110011 00010100100 00010011011 000100001000 000011110110 000011100010 0000110001011 0000101111110 0000101101010 000001001",
        "001000010 00011110 000111011 000111000 0001100110 00010111001 00010101101 000100001001 00010001110 000011111101 000011101000 0000110010000 0000110000100 0000101111010 00000110111101 0000010000",
        "0001101111 000110110 000110100 0001100100 00010111000 00010110010 00010100000 00010000101 000100000001 000011110100 000011100100 000011011001 0000110000001 0000101101110 00001011001011 0000001010",
        "0001100010 000110000 0001011011 0001011000 00010100101 00010011101 00010010100 000100000101 000011111000 0000110010111 0000110001101 0000101110100 0000101111100 000001101111001 000001101110100 0000001000",
        "0001010101 0001010100 0001010001 00010011111 00010011100 00010001111 000100000100 000011111001 0000110101011 0000110010001 0000110001000 0000101111111 00001011010111 00001011001001 00001011000100 0000000111",
        "00010011010 0001001100 0001001001 00010001101 00010000011 000100000000 000011110101 0000110101010 0000110010110 0000110001010 0000110000000 00001011011111 0000101100111 00001011000110 0000101100000 00000001011",
        "00010001011 00010000001 0001000011 00001111101 000011110111 000011101001 000011100101 000011011011 0000110001001 00001011100111 00001011100001 00001011010000 000001101110101 000001101110010 00000110110111 0000000100",
        "000011110011 00001111000 00001110110 00001110011 000011100011 000011011111 0000110001100 00001011101010 00001011100110 00001011100000 00001011010001 00001011001000 00001011000010 0000011011111 00000110110100 00000000110",
        "000011001010 000011100000 000011011110 000011011010 000011011000 0000110000101 0000110000010 0000101111101 0000101101100 000001101111000 00000110111011 00001011000011 00000110111000 00000110110101 0000011011000000 00000000100",
        "00001011101011 000011010011 000011010010 000011010000 0000101110010 0000101111011 00001011011110 00001011010011 00001011001010 0000011011000111 000001101110011 000001101101101 000001101101100 00000110110000011 000001101100001 00000000010",
        "0000101111001 0000101110001 00001100110 000010111011 00001011010110 00001011010010 0000101100110 00001011000111 00001011000101 000001101100010 0000011011000110 000001101100111 00000110110000010 000001101100110 00000110110010 00000000000",
        "000001100 00001010 00000111 000001011 000001010 0000010001 0000001011 0000001001 00000001101 00000001100 00000001010 00000000111 00000000101 00000000011 00000000001 00000011",
    ),
    24: (
        "1111 1101 101110 1010000 10010010 100000110 011111000 0110110010 0110101010 01010011101 01010001101 01010001001 01001101101 01000000101 010000001000 001011000",
        "1110 1100 10101 100110 1000111 10000010 01111010 011011000 011010001 011000110 0101000111 0101011001 0100111111 0100101001 0100010111 00101010",
        "101111 10110 101001 1001010 1000100 10000000 01111000 011011101 011001111 011000010 010110110 0101010100 0100111011 0100100111 01000011101 0010010",
        "1010001 100111 1001011 1000110 10000110 01111101 01110100 011011100 011001100 010111110 010110010 0101000101 0100110111 0100100101 0100001111 0010000",
        "10010011 1001000 1000101 10000111 01111111 01110110 01110000 011010010 011001000 010111100 0101100000 0101000011 0100110010 0100011101 01000011100 0001110",
        "100000111 1000010 10000001 01111110 01110111 01110010 011010110 011001010 011000000 010110100 0101010101 0100111101 0100101101 0100011001 0100000110 0001100",
        "011111001 01111011 01111001 01110101 01110001 011010111 011001110 011000011 010111001 0101011011 0101001010 0100110100 0100100011 0100010000 01000001000 0001010",
        "0110110011 01110011 01101111 01101101 011010011 011001011 011000100 010111011 0101100001 0101001100 0100111001 0100101010 0100011011 01000010011 00101111101 00010001",
        "0110101011 011010100 011010000 011001101 011001001 011000001 010111010 010110001 010101001 0101000000 0100101111 0100011110 0100001100 01000000010 00101111001 00010000",
        "0101001111 011000111 011000101 010111111 010111101 010110101 010101110 0101001101 0101000001 0100110001 0100100001 0100010011 01000001001 00101111011 00101110011 00001011",
        "01010011100 010111000 010110111 010110011 010101111 0101011000 0101001011 0100111010 0100110000 0100100010 0100010101 01000010010 00101111111 00101110101 00101101110 00001010",
        "01010001100 0101011010 010101011 010101000 010100100 0100111110 0100110101 0100101011 0100011111 0100010100 0100000111 01000000001 00101110111 00101110000 00101101010 00000110",
        "01010001000 0101000010 0100111100 0100111000 0100110011 0100101110 0100100100 0100011100 0100001101 0100000101 01000000000 00101111000 00101110010 00101101100 00101100111 00000100",
        "01001101100 0100101100 0100101000 0100100110 0100100000 0100011010 0100010001 0100001010 01000000011 00101111100 00101110110 00101110001 00101101101 00101101001 00101100101 00000010",
        "010000001001 0100011000 0100010110 0100010010 0100001011 0100001000 0100000011 00101111110 00101111010 00101110100 00101101111 00101101011 00101101000 00101100110 00101100100 00000000",
        "00101011 0010100 0010011 0010001 0001111 0001101 0001011 0001001 0000111 0000110 0000100 00000111 00000101 00000011 00000001 0011",
    ),
}
#: The synthesis window in 65536ths.
WINDOW = (
    0, -1, -1, -1, -1, -1, -1, -2, -2, -2, -2, -3, -3, -4, -4, -5,
    -5, -6, -7, -7, -8, -9, -10, -11, -13, -14, -16, -17, -19, -21, -24, -26,
    -29, -31, -35, -38, -41, -45, -49, -53, -58, -63, -68, -73, -79, -85, -91, -97,
    -104, -111, -117, -125, -132, -139, -147, -154, -161, -169, -176, -183, -190, -196, -202, -208,
    213, 218, 222, 225, 227, 228, 228, 227, 224, 221, 215, 208, 200, 189, 177, 163,
    146, 127, 106, 83, 57, 29, -2, -36, -72, -111, -153, -197, -244, -294, -347, -401,
    -459, -519, -581, -645, -711, -779, -848, -919, -991, -1064, -1137, -1210, -1283, -1356, -1428, -1498,
    -1567, -1634, -1698, -1759, -1817, -1870, -1919, -1962, -2001, -2032, -2057, -2075, -2085, -2087, -2080, -2063,
    2037, 2000, 1952, 1893, 1822, 1739, 1644, 1535, 1414, 1280, 1131, 970, 794, 605, 402, 185,
    -45, -288, -545, -814, -1095, -1388, -1692, -2006, -2330, -2663, -3004, -3351, -3705, -4063, -4425, -4788,
    -5153, -5517, -5879, -6237, -6589, -6935, -7271, -7597, -7910, -8209, -8491, -8755, -8998, -9219, -9416, -9585,
    -9727, -9838, -9916, -9959, -9966, -9935, -9863, -9750, -9592, -9389, -9139, -8840, -8492, -8092, -7640, -7134,
    6574, 5959, 5288, 4561, 3776, 2935, 2037, 1082, 70, -998, -2122, -3300, -4533, -5818, -7154, -8540,
    -9975, -11455, -12980, -14548, -16155, -17799, -19478, -21189, -22929, -24694, -26482, -28289, -30112, -31947, -33791, -35640,
    -37489, -39336, -41176, -43006, -44821, -46617, -48390, -50137, -51853, -53534, -55178, -56778, -58333, -59838, -61289, -62684,
    -64019, -65290, -66494, -67629, -68692, -69679, -70590, -71420, -72169, -72835, -73415, -73908, -74313, -74630, -74856, -74992,
    75038, 74992, 74856, 74630, 74313, 73908, 73415, 72835, 72169, 71420, 70590, 69679, 68692, 67629, 66494, 65290,
    64019, 62684, 61289, 59838, 58333, 56778, 55178, 53534, 51853, 50137, 48390, 46617, 44821, 43006, 41176, 39336,
    37489, 35640, 33791, 31947, 30112, 28289, 26482, 24694, 22929, 21189, 19478, 17799, 16155, 14548, 12980, 11455,
    9975, 8540, 7154, 5818, 4533, 3300, 2122, 998, -70, -1082, -2037, -2935, -3776, -4561, -5288, -5959,
    6574, 7134, 7640, 8092, 8492, 8840, 9139, 9389, 9592, 9750, 9863, 9935, 9966, 9959, 9916, 9838,
    9727, 9585, 9416, 9219, 8998, 8755, 8491, 8209, 7910, 7597, 7271, 6935, 6589, 6237, 5879, 5517,
    5153, 4788, 4425, 4063, 3705, 3351, 3004, 2663, 2330, 2006, 1692, 1388, 1095, 814, 545, 288,
    45, -185, -402, -605, -794, -970, -1131, -1280, -1414, -1535, -1644, -1739, -1822, -1893, -1952, -2000,
    2037, 2063, 2080, 2087, 2085, 2075, 2057, 2032, 2001, 1962, 1919, 1870, 1817, 1759, 1698, 1634,
    1567, 1498, 1428, 1356, 1283, 1210, 1137, 1064, 991, 919, 848, 779, 711, 645, 581, 519,
    459, 401, 347, 294, 244, 197, 153, 111, 72, 36, 2, -29, -57, -83, -106, -127,
    -146, -163, -177, -189, -200, -208, -215, -221, -224, -227, -228, -228, -227, -225, -222, -218,
    213, 208, 202, 196, 190, 183, 176, 169, 161, 154, 147, 139, 132, 125, 117, 111,
    104, 97, 91, 85, 79, 73, 68, 63, 58, 53, 49, 45, 41, 38, 35, 31,
    29, 26, 24, 21, 19, 17, 16, 14, 13, 11, 10, 9, 8, 7, 7, 6,
    5, 5, 4, 4, 3, 3, 2, 2, 2, 2, 1, 1, 1, 1, 1, 1,
)
