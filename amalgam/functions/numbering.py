"""Calling codes and the lengths of national numbers, as a trie of digits that is compiled into one pattern.

A number is led by its code, of which none begins another; what follows must have one of the lengths that numbers of that code
have. Each digit of the code is looked at once, in one pattern, however many codes there are, so plans do not grow with them.
"""

from __future__ import annotations

# ---- Fixed values below: calling codes as assigned, and how many digits national numbers have. ----

#: Last digits of codes, by what stands before them.
CODES = {
    "": "17", "2": "07", "3": "0123469", "4": "013456789", "5": "12345678", "6": "0123456", "8": "1246", "9": "0123458",
    "21": "12368", "22": "0123456789", "23": "0123456789", "24": "0123456789", "25": "012345678", "26": "0123456789", "29": "01789", "35": "0123456789",
    "37": "0123456789", "38": "01235679", "42": "013", "50": "0123456789", "59": "0123456789", "67": "023456789", "68": "012356789", "69": "012",
    "80": "08", "85": "02356", "87": "08", "88": "012368", "96": "012345678", "97": "01234567", "99": "234568",
}

#: Fewest and most digits after a code, where they are narrower than USUAL.
LENGTHS = {
    "1": (10, 10), "7": (10, 10), "31": (5, 11), "32": (8, 9), "33": (9, 9), "34": (9, 9), "36": (8, 9), "39": (6, 12), "40": (9, 9), "41": (9, 12), "43": (4, 13), "45": (8, 8),
    "46": (6, 12), "47": (5, 8), "48": (6, 10), "49": (4, 13), "51": (8, 9), "52": (10, 11), "54": (10, 11), "55": (8, 11), "56": (9, 11), "57": (8, 11), "58": (10, 10), "60": (8, 10),
    "61": (5, 12), "64": (5, 10), "65": (8, 11), "84": (7, 10), "86": (7, 12), "91": (8, 13), "93": (9, 9), "94": (9, 9), "95": (6, 10), "98": (4, 10), "212": (9, 9), "213": (8, 9),
    "216": (8, 8), "233": (8, 9), "254": (7, 10), "351": (9, 9), "353": (7, 10), "354": (7, 9), "370": (8, 8), "371": (8, 8), "380": (9, 10), "385": (6, 9), "386": (5, 8), "421": (6, 9),
    "853": (7, 8), "880": (6, 10), "886": (7, 11), "965": (7, 8), "966": (9, 10), "968": (7, 9), "973": (8, 8),
}
USUAL = (4, 13)

#: Digits of a whole number with its code.
WHOLE = (8, 15)


def calling_codes() -> dict[str, tuple[int, int]]:
    """Every code and the lengths of its national numbers."""
    return {lead + last: LENGTHS.get(lead + last, USUAL) for lead, lasts in CODES.items() for last in lasts}


def trie(codes: dict[str, tuple[int, int]]) -> dict:
    root: dict = {}
    for code, lengths in codes.items():
        node = root
        for digit in code:
            node = node.setdefault(digit, {})
        node[""] = lengths
    return root


def pattern_of(node: dict) -> str:
    """What may follow a node. Digits that lead to the same are one class."""
    ways: dict[str, str] = {}
    for digit, below in node.items():
        rest = rf"\d{{{below[0]},{below[1]}}}" if digit == "" else pattern_of(below)
        ways[rest] = ways.get(rest, "") + digit
    told = [(f"[{digits}]" if len(digits) > 1 else digits) + rest for rest, digits in ways.items()]
    return told[0] if len(told) == 1 else f"(?:{'|'.join(told)})"


#: Digits of a number with its code that can be dialled from abroad.
ABROAD = rf"^(?=\d{{{WHOLE[0]},{WHOLE[1]}}}$){pattern_of(trie(calling_codes()))}$"
