"""Characters and small tables that define the language's text."""

# They define what is a letter, punctuation, a pair, a unit or an ordinal.
LETTERS = "aâàbcçdeêéèëfghiïîjklmnñoôpqrstuüùûvwxyzœ"
PUNCTUATION = '.?!,‚;:«»“”"()[]/…–—•~'
PUNCT_PAIRS = {"«": "»", "“": "”", "(": ")", "[": "]"}
VALID_CHARS = LETTERS + LETTERS.upper() + PUNCTUATION + "-'<> "
FILLERS = {
    "boñ": "B ON", "bah": "B A", "beñ": "B EN", "beh": "B E", "euh": "OE", "euhm": "OE M", "ebah": "E B A", "ebeñ": "E B EN", "enfin": "AN F EN", "feñ": "F EN",
    "hañ": "H AN", "heñ": "EN", "kwa": "K W A", "tiens": "T I EN", "alors": "A L OH R", "allez": "A L E", "voilà": "V O A L A", "pff": "P F F", "mais": "M EH", "hmm": "M M",
}
UNITS = {
    "g": "gramm", "kg": "kilo", "µg": "mikro gramm", "t": "tonenn", "l": "litr", "cl": "santilitr", "ml": "mililitr", "cm": "santimetr", "sm": "santimetr",
    "cm2": "santimetr karrez", "cm²": "santimetr karrez", "cm3": "santimetr diñs", "m": "metr", "m2": "metr karrez", "m²": "metr karrez", "m3": "metr diñs", "m³": "metr diñs",
    "km": "kilometr", "c'hm": "c'hilometr", "km2": "kilometr karrez", "km²": "kilometr karrez", "km³": "kilometr diñs", "mn": "munutenn", "€": "euro", "$": "dollar",
    "k€": "mil euro", "M€": "milion euro", "%": "dre gant", "°C": "derez celsius",
}
ORDINALS = {
    "1añ": "kentañ", "2vet": "eilvet", "3de": "trede", "3e": "trede", "3vet": "teirvet", "4e": "pevare", "4re": "pevare", "4vet": "pedervet", "5vet": "pempvet",
    "6ed": "c'hwec'hvet", "6vet": "c'hwec'hvet", "8et": "eizhvet", "9vet": "navet", "15vet": "pempzekvet", "19vet": "naontekvet",
}
ROMAN_ORDINALS = {"Iañ": "kentañ", "IIvet": "eilvet", "IIIde": "trede", "IIIe": "trede", "IIIvet": "teirvet", "IVe": "pevare", "IVvet": "pedervet", "IXvet": "navet"}
