"""Statements in several dialects: how they are written in a script, what is sent, and on which line the code begins."""

# Of each form: the text in the script, the statement, the lines above its code, and how many lines it takes.
MYSQL_FORMS = [
    ("# note; {s}\nSELECT '{s}\\'; x';\n", "# note; {s}\nSELECT '{s}\\'; x'", 1, 2),
    ("SELECT `{s};``b`;\n", "SELECT `{s};``b`", 0, 1),
    ("DELIMITER //\nBEGIN {s}; END//\ndelimiter ;\n", "BEGIN {s}; END", 1, 3),
    ("-- it's\n/* ; */ SELECT {s};\n", "-- it's\n/* ; */ SELECT {s}", 1, 2),
]
ORACLE_FORMS = [
    ("SELECT {s};\n", "SELECT {s}", 0, 1),
    ("CREATE OR REPLACE PROCEDURE p AS\nBEGIN\n  {s};\nEND;\n/\n", "CREATE OR REPLACE PROCEDURE p AS\nBEGIN\n  {s};\nEND;", 0, 5),
    ("/* a\nb */ DECLARE\n  v INT; -- {s}\nBEGIN\n  x('\n/\n');\nEND;\n/\n", "/* a\nb */ DECLARE\n  v INT; -- {s}\nBEGIN\n  x('\n/\n');\nEND;", 1, 9),
]
DOLLAR_FORMS = [
    ("SELECT $${s}; 'x$$;\n", "SELECT $${s}; 'x$$", 0, 1),
    ("DO $b1$\n{s}; $$ ; $b2$\n$b1$;\n", "DO $b1$\n{s}; $$ ; $b2$\n$b1$", 0, 3),
    ("SELECT '{s};$$', \"a;\"\"$b$\";\n", "SELECT '{s};$$', \"a;\"\"$b$\"", 0, 1),
    ("/* ;\n $$ */ SELECT {s};\n", "/* ;\n $$ */ SELECT {s}", 1, 2),
]
