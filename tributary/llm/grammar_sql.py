"""Spark SQL: tokens and grammar of statements separated by semicolons."""

from __future__ import annotations

import re

GRAMMAR = """
script: ';'* (statement (';'+ statement)*)? ';'*
statement: query / insert / create / drop / alter / merge / update / delete / truncate / describe / show / explain / use / set / cache / refresh / analyze / comment_on / grant_like / values_statement / multi_insert / call / declare
explain: 'EXPLAIN' ('EXTENDED' / 'CODEGEN' / 'COST' / 'FORMATTED' / 'LOGICAL')? statement
use: 'USE' ('NAMESPACE' / 'DATABASE' / 'SCHEMA' / 'CATALOG')? (name / STRING)
set: ('SET' / 'RESET') anything*
cache: 'CACHE' 'LAZY'? 'TABLE' name ('OPTIONS' properties)? ('AS'? query)? / 'UNCACHE' 'TABLE' if_exists? name / 'CLEAR' 'CACHE'
refresh: 'REFRESH' ('TABLE' name / 'FUNCTION' name / anything+) / 'MSCK' 'REPAIR' 'TABLE' name (('ADD' / 'DROP' / 'SYNC') 'PARTITIONS')? / 'REPAIR' 'TABLE' name
analyze: 'ANALYZE' ('TABLE' name partition? 'COMPUTE' 'STATISTICS' ('NOSCAN' / 'FOR' 'COLUMNS' names / 'FOR' 'ALL' 'COLUMNS')? / 'TABLES' (('IN' / 'FROM') name)? 'COMPUTE' 'STATISTICS' 'NOSCAN'?)
comment_on: 'COMMENT' 'ON' ('TABLE' / 'DATABASE' / 'SCHEMA' / 'NAMESPACE' / 'COLUMN') name 'IS' (STRING / 'NULL')
grant_like: ('GRANT' / 'REVOKE' / 'LOCK' / 'UNLOCK' / 'ADD' / 'LIST' / 'DFS') anything+
call: 'CALL' name '(' (call_arg (',' call_arg)*)? ')' / 'EXECUTE' 'IMMEDIATE' expr ('INTO' names)? ('USING' named_exprs)?
call_arg: ident '=>' expr / expr
declare: 'DECLARE' ('OR' 'REPLACE')? 'VARIABLE'? names type? (('DEFAULT' / '=') expr)?
anything: !(';' / EOF) ANY
describe: ('DESCRIBE' / 'DESC') ('FUNCTION' 'EXTENDED'? (name / STRING) / ('DATABASE' / 'SCHEMA' / 'NAMESPACE') 'EXTENDED'? name / 'QUERY'? query / 'TABLE'? ('EXTENDED' / 'FORMATTED')? name partition? name? ('AS' 'JSON')?)
show: 'SHOW' (('DATABASES' / 'SCHEMAS' / 'NAMESPACES' / 'TABLES' / 'VIEWS' / 'PROCEDURES') in_name? like? / 'TABLE' 'EXTENDED' in_name? 'LIKE' STRING partition? / 'TBLPROPERTIES' name ('(' (name / STRING) ')')? / 'COLUMNS' in_name in_name? / 'PARTITIONS' name partition? / 'CREATE' 'TABLE' name ('AS' 'SERDE')? / 'CURRENT' ident / ('CATALOGS' / 'COLLATIONS') like? / 'FUNCTIONS' in_name? ('LIKE'? (STRING / name))? / ident 'FUNCTIONS' in_name? ('LIKE'? (STRING / name))?)
in_name: ('FROM' / 'IN') name
like: 'LIKE'? STRING
truncate: 'TRUNCATE' 'TABLE' name partition?
drop: 'DROP' ('TEMPORARY' / 'TEMP')? ('TABLE' / 'VIEW' / 'FUNCTION' / 'DATABASE' / 'SCHEMA' / 'NAMESPACE' / 'VARIABLE' / 'INDEX') if_exists? name ('PURGE' / 'CASCADE' / 'RESTRICT')?
if_exists: 'IF' 'EXISTS'
if_not_exists: 'IF' 'NOT' 'EXISTS'
alter: 'ALTER' ('TABLE' name alter_table / 'VIEW' name (alter_table / 'AS'? query / 'WITH' 'SCHEMA' ident) / ('DATABASE' / 'SCHEMA' / 'NAMESPACE') name anything+)
alter_table: 'RENAME' ('TO' name / 'COLUMN' name 'TO' ident / partition 'TO' partition) / 'ADD' ('COLUMN' / 'COLUMNS') ('(' column_add (',' column_add)* ')' / column_add (',' column_add)*) / 'ADD' if_not_exists? (partition ('LOCATION' STRING)?)+ / 'ADD' 'CONSTRAINT' anything+ / 'DROP' ('COLUMN' / 'COLUMNS') if_exists? ('(' names ')' / names) / 'DROP' if_exists? partition (',' partition)* 'PURGE'? / 'DROP' 'CONSTRAINT' anything+ / 'SET' ('TBLPROPERTIES' properties / 'LOCATION' STRING / 'SERDE' STRING anything* / 'SERDEPROPERTIES' properties) / 'UNSET' 'TBLPROPERTIES' if_exists? '(' property_key (',' property_key)* ')' / ('ALTER' / 'CHANGE') 'COLUMN'? name ident? column_change / 'REPLACE' 'COLUMNS' '(' column_defs ')' / partition 'SET' 'LOCATION' STRING / 'RECOVER' 'PARTITIONS' / 'CLUSTER' 'BY' ('NONE' / '(' names ')')
column_add: name type column_option* ('FIRST' / 'AFTER' ident)?
column_change: ('TYPE' type / 'COMMENT' STRING / ('SET' / 'DROP') 'NOT' 'NULL' / ('SET' 'DEFAULT' expr / 'DROP' 'DEFAULT') / 'FIRST' / 'AFTER' ident / type)+
create: 'CREATE' ('OR' 'REPLACE')? (create_view / create_function / create_table / create_database / create_index) / 'REPLACE' create_table
create_database: ('DATABASE' / 'SCHEMA' / 'NAMESPACE') if_not_exists? name (comment / 'LOCATION' STRING / 'WITH' ('DBPROPERTIES' / 'PROPERTIES') properties)*
create_index: 'INDEX' if_not_exists? ident 'ON' 'TABLE'? name anything*
create_view: ('GLOBAL'? ('TEMPORARY' / 'TEMP'))? 'VIEW' if_not_exists? name ('(' view_column (',' view_column)* ')')? (comment / 'PARTITIONED' 'ON' '(' names ')' / 'TBLPROPERTIES' properties / 'WITH' 'SCHEMA' ident)* 'AS' query / ('GLOBAL'? ('TEMPORARY' / 'TEMP')) 'VIEW' name ('(' column_defs ')')? 'USING' name ('OPTIONS' properties)?
view_column: ident (comment)?
create_function: ('TEMPORARY' / 'TEMP')? 'FUNCTION' if_not_exists? name ('AS' STRING ('USING' ident STRING (',' ident STRING)*)? / '(' (function_param (',' function_param)*)? ')' ('RETURNS' (type / 'TABLE' ('(' column_defs ')')?))? function_option* 'RETURN' (query / expr))
function_param: ident type ('DEFAULT' expr / comment)*
function_option: comment / 'NOT'? 'DETERMINISTIC' / 'LANGUAGE' ident / 'CONTAINS' 'SQL' / 'READS' 'SQL' 'DATA' / 'SQL' 'SECURITY' ident
create_table: ('TEMPORARY' / 'TEMP')? 'EXTERNAL'? 'TABLE' if_not_exists? name 'LIKE' name table_clause* / ('TEMPORARY' / 'TEMP')? 'EXTERNAL'? 'TABLE' if_not_exists? name ('(' table_parts ')')? table_clause* ('AS'? query)?
table_parts: table_part (',' table_part)*
table_part: 'CONSTRAINT' ident constraint / constraint / column_def
constraint: 'PRIMARY' 'KEY' '(' names ')' ident* / 'UNIQUE' '(' names ')' / 'CHECK' '(' expr ')' ident* / 'FOREIGN' 'KEY' '(' names ')' 'REFERENCES' name ('(' names ')')?
column_defs: column_def (',' column_def)*
column_def: ident ':'? type column_option*
column_option: 'NOT' 'NULL' / comment / 'DEFAULT' expr / 'GENERATED' ('ALWAYS' / 'BY' 'DEFAULT') 'AS' ('IDENTITY' ('(' anything_in ')')? / '(' expr ')') / 'PRIMARY' 'KEY' / 'UNIQUE' / 'CHECK' '(' expr ')' / 'REFERENCES' name ('(' names ')')? / 'CONSTRAINT' ident / 'COLLATE' name
anything_in: (!')' ANY)+
table_clause: 'USING' name / 'OPTIONS' properties / 'PARTITIONED' 'BY' '(' partition_field (',' partition_field)* ')' / 'CLUSTERED' 'BY' '(' names ')' ('SORTED' 'BY' '(' sort_item (',' sort_item)* ')')? 'INTO' NUMBER 'BUCKETS' / 'CLUSTER' 'BY' '(' names ')' / 'SKEWED' 'BY' anything_until / 'ROW' 'FORMAT' row_format / 'STORED' ('AS' ('INPUTFORMAT' STRING 'OUTPUTFORMAT' STRING / ident) / 'BY' STRING) / 'LOCATION' STRING / comment / 'TBLPROPERTIES' properties / 'DEFAULT' 'COLLATION' name / 'WITH' 'SERDEPROPERTIES' properties
anything_until: '(' anything_in ')' 'ON' '(' (!';' ANY)*
row_format: 'SERDE' STRING ('WITH' 'SERDEPROPERTIES' properties)? / 'DELIMITED' (!('STORED' / 'LOCATION' / 'COMMENT' / 'TBLPROPERTIES' / 'AS' / 'USING' / ';' / EOF) ANY)*
partition_field: ident '(' exprs ')' / column_def / name
comment: 'COMMENT' STRING
properties: '(' (property (',' property)*)? ')'
property: property_key ('='? property_value)?
property_key: ident ('.' ident)* / STRING
property_value: '-'? NUMBER / 'TRUE' / 'FALSE' / STRING / expr
insert: with? 'INSERT' ('INTO' / 'OVERWRITE') ('DIRECTORY' directory / 'LOCAL' 'DIRECTORY' directory / 'TABLE'? name options? ('REPLACE' ('WHERE' expr)) source / 'TABLE'? name options? alias_free? partition? if_not_exists? ('BY' 'NAME' / '(' names ')')? source) / with? 'INSERT' 'INTO' 'TABLE'? name 'SET' assignments
alias_free: 'AS' ident
directory: STRING? ('USING' name ('OPTIONS' properties)?)? ('ROW' 'FORMAT' row_format)? ('STORED' 'AS' ident)? source
options: 'WITH' properties
source: query
multi_insert: 'FROM' relations lateral_view* (insert_part / select_part)+
insert_part: 'INSERT' ('INTO' / 'OVERWRITE') 'TABLE'? name partition? if_not_exists? ('(' names ')')? select_part
select_part: 'SELECT' quantifier? select_items lateral_view* where? group? having? order_parts
partition: 'PARTITION' '(' partition_value (',' partition_value)* ')'
partition_value: ident (COMPARE expr)? / expr
update: 'UPDATE' name table_alias? 'SET' assignments where?
assignments: name '=' (expr) (',' name '=' (expr))*
delete: 'DELETE' 'FROM' name table_alias? where?
merge: with? 'MERGE' ('WITH' 'SCHEMA' 'EVOLUTION')? 'INTO' name table_alias? 'USING' ('(' query ')' / name) table_alias? 'ON' expr merge_when+
merge_when: 'WHEN' 'NOT'? 'MATCHED' ('BY' ('SOURCE' / 'TARGET'))? ('AND' expr)? 'THEN' ('DELETE' / 'UPDATE' 'SET' ('*' / assignments) / 'INSERT' ('*' / '(' names ')' 'VALUES' '(' exprs ')'))
values_statement: values
names: name (',' name)*
query: with? query_term order_parts
with: 'WITH' 'RECURSIVE'? cte (',' cte)*
cte: ident ('(' names ')')? ('MAX' 'RECURSION' 'LEVEL' NUMBER)? 'AS'? '(' query ')'
query_term: query_primary (('UNION' / 'INTERSECT' / 'EXCEPT' / 'MINUS') ('ALL' / 'DISTINCT')? ('BY' 'NAME')? query_primary)* pipe*
pipe: '|>' (!(';' / ')' / '|>' / EOF) piped)+
piped: '(' (piped)* ')' / !')' ANY
query_primary: select / '(' query ')' / 'TABLE' name / values table_alias? / 'FROM' relations lateral_view* select_part?
values: 'VALUES' expr (',' expr)*
select: 'SELECT' hint* quantifier? select_items ('INTO' names)? ('FROM' relations)? lateral_view* where? group? having? qualify? windows?
hint: HINT
quantifier: ('DISTINCT' / 'ALL') !('.' / ',' / COMPARE)
select_items: select_item (',' select_item)*
select_item: star_item / expr (alias / '(' names ')')?
star_item: (name '.')? '*' ('EXCEPT' '(' names ')')? ('REPLACE' '(' anything_in ')')?
alias: 'AS' (any_ident / '(' names ')') / ident / trailing
trailing: any_ident &(';' / EOF)
trailing_alias: !('ANTI' / 'CROSS' / 'EXCEPT' / 'FULL' / 'INNER' / 'INTERSECT' / 'JOIN' / 'LATERAL' / 'LEFT' / 'NATURAL' / 'ON' / 'RIGHT' / 'SEMI' / 'MINUS' / 'UNION' / 'USING') trailing
relations: relation (',' relation)* pivot?
relation: 'LATERAL'? relation_primary (join / pivot / lateral_view)*
join: join_type 'JOIN' 'LATERAL'? relation_primary join_on? / 'NATURAL' join_type 'JOIN' relation_primary
join_type: 'INNER'? !('LEFT' / 'RIGHT' / 'FULL' / 'SEMI' / 'ANTI' / 'CROSS') / 'CROSS' / 'LEFT' ('OUTER' / 'SEMI' / 'ANTI')? / 'RIGHT' 'OUTER'? / 'FULL' 'OUTER'? / 'SEMI' / 'ANTI'
join_on: 'ON' expr / 'USING' '(' names ')'
relation_primary: '(' query ')' sample? table_alias? / '(' relation (',' relation)* ')' sample? table_alias? / values table_alias? / 'STREAM'? 'TABLE'? name '(' function_args? ')' table_alias? / 'TABLE' '(' anything_in ')' table_alias? / name time_travel? options? sample? watermark? table_alias?
watermark: 'WATERMARK' expr 'DELAY' 'OF' expr
time_travel: ('FOR'? ('SYSTEM_VERSION' / 'VERSION') 'AS' 'OF' primary) / ('FOR'? ('SYSTEM_TIME' / 'TIMESTAMP') 'AS' 'OF' primary)
sample: 'TABLESAMPLE' 'SYSTEM'? '(' anything_in ')' ('REPEATABLE' '(' NUMBER ')')?
table_alias: 'AS'? strict_ident ('(' names ')')? / 'AS'? trailing_alias
pivot: 'PIVOT' '(' select_items 'FOR' (name / '(' names ')') 'IN' '(' (expr alias? (',' expr alias?)*) ')' ')' table_alias? / 'UNPIVOT' (('INCLUDE' / 'EXCLUDE') 'NULLS')? '(' anything_deep ')' table_alias?
anything_deep: (!('(' / ')') ANY / '(' anything_deep ')')*
lateral_view: 'LATERAL' 'VIEW' 'OUTER'? name '(' exprs? ')' strict_ident? ('AS'? strict_ident (',' strict_ident)*)?
where: 'WHERE' expr
group: 'GROUP' 'BY' ('ALL' / group_item (',' group_item)*) ('WITH' ('ROLLUP' / 'CUBE') / grouping_sets)?
group_item: grouping_sets / ('ROLLUP' / 'CUBE') '(' exprs? ')' / expr
grouping_sets: 'GROUPING' 'SETS' '(' grouping_set (',' grouping_set)* ')'
grouping_set: '(' exprs? ')' / group_item
having: 'HAVING' expr
qualify: 'QUALIFY' expr
windows: 'WINDOW' ident 'AS' window (',' ident 'AS' window)*
order_parts: ('ORDER' 'BY' sort_item (',' sort_item)*)? ('CLUSTER' 'BY' exprs)? ('DISTRIBUTE' 'BY' exprs)? ('SORT' 'BY' sort_item (',' sort_item)*)? windows? ('LIMIT' ('ALL' / expr))? ('OFFSET' expr)?
sort_item: expr ('ASC' / 'DESC')? ('NULLS' ('FIRST' / 'LAST'))?
exprs: expr (',' expr)*
named_exprs: expr alias? (',' expr alias?)*
expr: and_expr ('OR' and_expr)*
and_expr: not_expr ('AND' not_expr)*
not_expr: ('NOT' / '!') not_expr / 'EXISTS' '(' query ')' / predicate
predicate: value predicate_rest*
predicate_rest: COMPARE ('ANY' / 'SOME' / 'ALL')? value / 'IS' 'NOT'? ('NULL' / 'TRUE' / 'FALSE' / 'UNKNOWN' / 'DISTINCT' 'FROM' value) / 'NOT'? ('BETWEEN' value 'AND' value / 'IN' '(' (query / exprs) ')' / ('LIKE' / 'ILIKE') ('ANY' / 'SOME' / 'ALL') '(' exprs? ')' / ('LIKE' / 'ILIKE' / 'RLIKE' / 'REGEXP') value ('ESCAPE' STRING)?)
value: bit_and (('|' / '^') bit_and)*
bit_and: shift ('&' shift)*
shift: sum (SHIFT sum)*
sum: term (('+' / '-' / '||') term)*
term: unary (('*' / '/' / '%' / 'DIV') unary)*
unary: ('+' / '-' / '~') unary / primary
primary: head tail*
tail: '.' (ident / any_ident / '*') / '[' expr ']' / '::' type / ':' path_part / 'COLLATE' name
path_part: ident / '[' (STRING / NUMBER / '*') ']'
head: 'CASE' (expr)? ('WHEN' expr 'THEN' expr)+ ('ELSE' expr)? 'END' / ('CAST' / 'TRY_CAST') '(' expr 'AS' type ')' / 'EXTRACT' '(' any_ident 'FROM' value ')' / interval / 'TRIM' '(' ('BOTH' / 'LEADING' / 'TRAILING')? expr? 'FROM' expr ')' / 'POSITION' '(' value 'IN' value ')' / ('SUBSTRING' / 'SUBSTR') '(' value 'FROM' value ('FOR' value)? ')' / 'OVERLAY' '(' value 'PLACING' value 'FROM' value ('FOR' value)? ')' / ('FIRST' / 'LAST' / 'ANY_VALUE') '(' expr 'IGNORE' 'NULLS' ')' call_rest / 'STRUCT' '(' named_exprs? ')' / call / typed_literal / literal / lambda / '(' query ')' / '(' named_exprs ')' / PARAMETER / ident / 'CASE' &(any_ident? (';' / EOF)) / trailing
typed_literal: ('DATE' / 'TIMESTAMP' / 'TIMESTAMP_NTZ' / 'TIMESTAMP_LTZ' / 'X') STRING
interval: 'INTERVAL' (interval_part+ / STRING) ('TO' any_ident)?
interval_part: ('-' / '+')? (NUMBER / STRING) any_ident
literal: 'NULL' / 'TRUE' / 'FALSE' / NUMBER / STRING+
lambda: ident '->' expr / '(' ident (',' ident)+ ')' '->' expr
call: call_name '(' ('DISTINCT' / 'ALL')? function_args? ('ORDER' 'BY' sort_item (',' sort_item)*)? ')' call_rest
call_name: name / 'LEFT' / 'RIGHT' / 'IF' / 'REPLACE' / 'ARRAY' / 'MAP' / 'FILTER' / 'EXISTS' / 'ANY' / 'SOME' / 'SET' / 'LIKE' / 'ILIKE' / 'RLIKE' / 'REGEXP'
function_args: function_arg (',' function_arg)*
function_arg: ident '=>' expr / '*' / 'TABLE' (name / '(' query ')') / query / star_item &(',' / ')') / expr alias?
call_rest: ('WITHIN' 'GROUP' '(' 'ORDER' 'BY' sort_item (',' sort_item)* ')')? ('FILTER' '(' 'WHERE' expr ')')? (('IGNORE' / 'RESPECT') 'NULLS')? ('OVER' window)?
window: ident / '(' (!('PARTITION' / 'DISTRIBUTE' / 'ROWS' / 'RANGE') ident)? (('PARTITION' / 'DISTRIBUTE') 'BY' exprs)? (('ORDER' / 'SORT') 'BY' sort_item (',' sort_item)*)? ('CLUSTER' 'BY' exprs)? frame? ')'
frame: ('ROWS' / 'RANGE') ('BETWEEN' bound 'AND' bound / bound)
bound: 'UNBOUNDED' ('PRECEDING' / 'FOLLOWING') / 'CURRENT' 'ROW' / expr ('PRECEDING' / 'FOLLOWING')
type: ('ARRAY' '<' type close / 'MAP' '<' type ',' type close / 'STRUCT' ('<' (field (',' field)*)? close / EMPTY_ANGLES) / 'INTERVAL' any_ident ('TO' any_ident)? / any_ident ('(' NUMBER (',' '-'? NUMBER)* ')')? ('COLLATE' name)? 'PRECISION'?)
close: '>'
field: ident ':'? type ('NOT' 'NULL')? comment?
name: ident_or_function ('.' any_ident)*
ident_or_function: ident / trailing
"""

# The parser of the language takes almost any word for a name. Here clause words are names only where the
# statement ends with them (a rule called trailing), which is where cut-off texts differ.
# Words of the language that end an expression or start a clause and so name nothing without quotes here.
CLAUSE_WORDS = frozenset(
    "SELECT FROM WHERE GROUP HAVING ORDER LIMIT UNION EXCEPT INTERSECT MINUS JOIN ON USING LEFT RIGHT FULL INNER CROSS NATURAL SEMI ANTI LATERAL AS WITH WHEN THEN ELSE END CASE AND OR NOT IN IS BETWEEN LIKE ILIKE RLIKE REGEXP "
    "DISTRIBUTE CLUSTER SORT WINDOW QUALIFY NULL TRUE FALSE CAST TABLESAMPLE PIVOT UNPIVOT INTO SET DIV ESCAPE ASC DESC EXISTS FOR".split()
)
_WORDS = frozenset(re.findall(r"'([A-Z_]+)'", GRAMMAR))
_IDENT = sorted(_WORDS - CLAUSE_WORDS)
_STRICT = sorted(set(_IDENT) - {"REPLACE", "VALUES", "OFFSET", "FOR", "TIMESTAMP", "VERSION", "MATCHED"} | {"VALUES"})
_ANY = sorted(_WORDS)


def _alternatives(words) -> str:
    return " / ".join(["NAME", "QUOTED", *(f"'{w}'" for w in words)])


def grammar() -> str:
    every = sorted({"NAME", "QUOTED", "STRING", "NUMBER", "COMPARE", "SHIFT", "HINT", "PARAMETER", "EMPTY_ANGLES"})
    marks = [",", ".", "(", ")", "[", "]", "<", ">", "=", "*", "/", "+", "-", "%", "&", "|", "^", "~", "!", ":", "::", "->", "=>", "||", "|>", "{", "}", "@", "?", "$", "\\\\"]
    any_token = " / ".join([*every, *(f"'{m}'" for m in marks if m != "\\\\"), *(f"'{w}'" for w in _ANY), "OTHER"])
    return GRAMMAR.replace("ANY)", "any_token)").replace(" ANY\n", " any_token\n").replace(") ANY", ") any_token").replace("!')' ANY", "!')' any_token").replace("COMPARE", "compare").replace("compare: ", "") + f"""
compare: '=' / '<' / '>' / EQ
ident: {_alternatives(_IDENT)}
strict_ident: {_alternatives(_STRICT)}
any_ident: {_alternatives(_ANY)}
any_token: {any_token} / EQ
"""


_TOKEN = re.compile(
    r"(?P<blank>\s+|--[^\r\n]*)|(?P<hint>/\*\+[\s\S]*?\*/)|(?P<comment>/\*)|(?P<string>[rR]?(?:'(?:[^'\\]|\\[\s\S]|'')*'|\"(?:[^\"\\]|\\[\s\S]|\"\")*\"))|(?P<quoted>`(?:[^`]|``)*`)"
    r"|(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?:BD|[LSYDF])?(?![A-Za-z0-9_])|\d+(?=[A-Za-z_]))|(?P<name>[A-Za-z_0-9À-￿][A-Za-z0-9_À-￿]*)"
    r"|(?P<parameter>:[A-Za-z_]\w*|\?|\$\{[^}]*\})|(?P<op>\|>|<=>|<=|>=|<>|!=|==|=>|->|::|\|\||<<|>>>|>>|[-+*/%&|^~<>=!,.;()\[\]{}:@])|(?P<other>[\s\S])",
    re.I,
)
_EQ = {"<=>", "<=", ">=", "<>", "!=", "=="}


def _comment_end(text: str, pos: int) -> int:
    """End of a bracketed comment, which may hold others; -1 if it has none."""
    depth, at = 1, pos + 2
    for m in re.compile(r"/\*|\*/").finditer(text, at):
        depth += 1 if m.group() == "/*" else -1
        if not depth:
            return m.end()
    return -1


def tokens(text: str) -> tuple[list[str], list[int], str]:
    """(token classes, offsets, cause of a lexical failure)."""
    kinds, at, pos, n = [], [], 0, len(text)
    if text.startswith("﻿"):
        pos = 1
    cause, depth = "", 0
    while pos < n:
        m = _TOKEN.match(text, pos)
        kind, value = m.lastgroup, m.group()
        if kind == "blank":
            pos = m.end()
            continue
        if kind == "comment":
            end = _comment_end(text, pos)
            if end < 0:
                return [*kinds, "BAD", "EOF"], [*at, pos, pos], "unterminated comment"
            pos = end
            continue
        at.append(pos)
        pos = m.end()
        if kind == "string":
            kinds.append("STRING")
        elif kind == "quoted":
            kinds.append("QUOTED")
        elif kind == "number":
            kinds.append("NUMBER")
        elif kind == "name":
            word = value.upper()
            kinds.append(word if word in _WORDS else "NAME")
        elif kind == "hint":
            kinds.append("HINT")
        elif kind == "parameter":
            if value[0] == ":":
                kinds.append(":")
                pos = at[-1] + 1
            else:
                kinds.append("PARAMETER")
        elif kind == "op":
            if value in (">>", ">>>") and depth > 0:
                # closing angles of nested types
                kinds += [">"] * len(value)
                at += [at[-1] + i for i in range(1, len(value))]
                depth -= len(value)
            elif value == "<>" and kinds and kinds[-1] == "STRUCT":
                kinds.append("EMPTY_ANGLES")
            else:
                if value == "<" and kinds and kinds[-1] in ("ARRAY", "MAP", "STRUCT"):
                    depth += 1
                elif value == ">" and depth > 0:
                    depth -= 1
                kinds.append("EQ" if value in _EQ else "SHIFT" if value in ("<<", ">>", ">>>") else value)
        else:
            kinds.append("BAD")
            cause = cause or ("unterminated string" if value in "'\"`" else "character")
    kinds.append("EOF")
    at.append(n)
    return kinds, at, cause
