"""Grammars of the languages that are checked: C, Java, JavaScript, TypeScript, Rust, Go, JSON.

Rules are written over token classes, not names: undeclared names and types are no concern.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from sievework.llm.syntax.rules import BROKEN, Grammar, Rule

_C_COMMENT = r"//[^\n]*|/\*[\s\S]*?\*/"
_OPEN_COMMENT = r"/\*[\s\S]*"
_STRING = r'"(?:\\.|[^"\\\n])*"'
_OPEN_STRING = r'"[^\n]*'
_WORD = r"[^\W\d]\w*"
_NUMBER = r"0[xXbBoO][0-9a-fA-F_]+[a-zA-Z0-9_]*|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?[a-zA-Z_]\w*|\.?\d[\d_]*(?:\.\d[\d_]*|\.(?![.\w]))?(?:[eE][+-]?\d+)?"


@dataclass
class Language:
    grammar: Grammar
    tokens: re.Pattern
    #: first characters -> class of a token that is not a word
    skip: tuple[str, ...] = ("//", "/*")
    #: rules by bracket and name: ('list', rule) comma-separated, ('whole', rule), ('run', rule) statements
    rules: dict[str, dict[str, tuple[str, Rule]]] = field(default_factory=dict)
    top: Rule | None = None
    first: Rule | None = None
    #: token after which a line break ends a statement, and before which it does not
    ends_line: frozenset[str] | None = None
    joins_line: frozenset[str] = frozenset()
    #: tokens before which a closed block does not end its statement
    goes_on: str = ""
    #: words after which a block is part of a longer statement
    named_blocks: str = ""
    #: statements that contain semicolons before their block
    long_heads: str = ""

    def set_rules(self, text: dict[str, dict[str, tuple[str, str]]], top: str, first: str | None = None) -> None:
        g = self.grammar
        self.rules = {b: {n: (form, g.rule(r)) for n, (form, r) in by.items()} for b, by in text.items()}
        assert all(list(by) == g.kinds[b] for b, by in self.rules.items()), (g.name, self.rules)
        self.top = g.rule(top)
        self.first = g.rule(first) if first else None

    def chars(self, *words: str) -> str:
        return "".join(self.grammar.token(w) for w in words)


def _tokens(*parts: str) -> re.Pattern:
    return re.compile("|".join(parts))


def _ops(text: str) -> str:
    return "|".join(re.escape(x) for x in sorted(text.split(), key=len, reverse=True))


# ---------------------------------------------------------------- C
_C_OPS = "<<= >>= ... ++ -- -> && || == != <= >= += -= *= /= %= &= ^= |= << >> ##"


def c_language() -> Language:
    g = Grammar("c")
    g.declare(
        "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof "
        "static struct switch typedef union unsigned void volatile while _Bool",
        _C_OPS, {"(": "args params for", "[": "index", "{": "stmts fields list"},
    )
    g.macros = {
        "Qual": "const|volatile|static|extern|register|inline|restrict|auto|typedef",
        "Base": "int|char|short|long|float|double|void|signed|unsigned|_Bool",
        "Spec": "Qual* ( Base ( Base | Qual )* | ( struct | union | enum ) ( a B.fields/list ? | B.fields/list ) Qual* | a Qual* )",
        "Ptr": "( '*' | const | restrict | volatile )*",
        "Bin": "'+'|'-'|'*'|'/'|'%'|'&'|'^'|'<'|'>'|'?'|':'|'='|'&&'|'||'|'=='|'!='|'<='|'>='|'+='|'-='|'*='|'/='|'%='|'&='|'^='|'|='|'<<'|'>>'|'<<='|'>>='|Or",
        "Or": "'|'",
        "Pre": "'&'|'*'|'!'|'~'|'+'|'-'|'++'|'--'|sizeof|P.params",
        "Unit": "Pre* ( a | N | S ( S | a )* | P.args | sizeof P.params | P.params B.list ) ( P.args | I.index | '.' a | '->' a | '++' | '--' )*",
        "E": "Unit ( Bin Unit )*",
        "Init": "a I.index* ( '=' ( E | B.list ) )?",
        "Declarator": "Ptr ( a | P.args/params P.params ) ( I.index | P.params )* ( '=' ( E | B.list ) )? ( ':' N )?",
        "Decl": "Spec ( Declarator ( ',' Declarator )* )?",
        "Ctrl": "if P.args | else | while P.args | for P.for | switch P.args | do | case E ':' | default ':' | a ':'",
        "Simple": "E ( ',' E )* | Decl | return ( E | B.list )? | break | continue | goto a",
        "Stmt": "Ctrl* ( Simple? ';' | B.stmts ( Ctrl+ ( B.stmts | Simple? ';' ) )* ';'? )",
        "Func": "Spec Ptr a P.params B.stmts | Qual* a P.params B.stmts",
        "Unitless": "( Spec Ptr | Qual* ) a P.args ( B.stmts | ';' )",
    }
    lang = Language(
        g,
        _tokens(_C_COMMENT, r"(?m:^[ \t]*#[ \t]*(?:include|define|undef|if|ifdef|ifndef|elif|else|endif|pragma|error|warning|line)\b(?:\\\n|/\*[\s\S]*?\*/|[^\n])*)", _OPEN_COMMENT, _STRING, r"'(?:\\.|[^'\\\n])+'", _OPEN_STRING, _NUMBER, _WORD, _ops(_C_OPS), r"\S"),
        skip=("//", "/*", "#"),
    )
    lang.goes_on = lang.chars(";", ",", "=", ".", ")", "else")
    lang.named_blocks = lang.chars("struct", "union", "enum")
    lang.set_rules(
        {
            "(": {
                "args": ("list", "E | Spec Ptr"),
                "params": ("list", "Spec Ptr ( a | P.params/args P.params )? I.index* | '...' | void"),
                "for": ("whole", "( Decl | E ( ',' E )* )? ';' E? ';' ( E ( ',' E )* )?"),
            },
            "[": {"index": ("list", "( static | const )* E")},
            "{": {
                "stmts": ("run", "Stmt"),
                "fields": ("run", "Spec ( Declarator ( ',' Declarator )* )? ';'"),
                "list": ("list", "( ( '.' a | I.index )+ '=' )? ( E | B.list ) | a '=' E"),
            },
        },
        "Func | Decl ';' | extern S ( B.stmts | Decl ';' ) | Unitless | ';'",
    )
    return lang


# ---------------------------------------------------------------- Java
_JAVA_OPS = ">>>= <<= >>= >>> ... -> :: ++ -- && || == != <= >= += -= *= /= &= |= ^= %= <<"


def java_language() -> Language:
    g = Grammar("java")
    g.declare(
        "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import "
        "instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try "
        "void volatile while null true false",
        _JAVA_OPS, {"(": "args params for try", "[": "index", "{": "stmts members enum list"},
    )
    g.macros = {
        "Prim": "int|long|short|byte|char|boolean|float|double|void",
        "Annot": "'@' a ( '.' a )* P.args?",
        "Mod": "Annot|public|private|protected|static|final|abstract|native|synchronized|transient|volatile|strictfp|default",
        "Gen": "'<' ( a | '.' | ',' | '?' | extends | super | Prim | I.index | '&' | '<' | '>' | '>>>' | Annot )* '>'",
        "Type": "( Prim | Annot* a Gen? ( '.' a Gen? )* ) I.index*",
        "Types": "Type ( ( ',' | '&' ) Type )*",
        "Bin": "'+'|'-'|'*'|'/'|'%'|'&'|'^'|'>'|'<'|'?'|':'|'='|'&&'|'||'|'=='|'!='|'<='|'>='|'+='|'-='|'*='|'/='|'%='|'&='|'^='|'|='|'<<'|'>' '>'|'>>>'|'<<='|'>>='|'>>>='|'|'",
        "Lambda": "( a | P.params ) '->'",
        "Pre": "'!'|'~'|'+'|'-'|'++'|'--'|P.params|Lambda",
        "New": "new Type ( P.args B.members? | I.index* B.list? )",
        "Unit": "Pre* ( a | N | S | P.args | this | super | null | true | false | New | Prim I.index* '.' class | switch P.args B.stmts | Lambda B.stmts | Type '::' ( a | new ) ) "
        "( P.args | I.index | '.' Gen? ( a | this | class | super | New ) | '::' ( a | new ) | '++' | '--' )* ( instanceof final? Type a? )?",
        "E": "Unit ( Bin Unit )*",
        "Var": "Mod* Type a I.index* ( '=' ( E | B.list ) )? ( ',' a I.index* ( '=' ( E | B.list ) )? )*",
        "Class": "Mod* ( class | interface | '@' interface ) a Gen? ( extends Types )? ( implements Types )? ( a Types )? B.members | Mod* enum a ( implements Types )? B.enum | Mod* a a Gen? P.params ( implements Types )? B.members",
        "Label": "case ( E ( ',' E )* | Type a ) ( ':' | '->' ) | default ( ':' | '->' )",
        "Ctrl": "if P.args | else | while P.args | for P.for | switch P.args | do | try P.try? | catch P.params | finally | synchronized P.args | Label | a ':'",
        "Simple": "E ( ',' E )* | Var | return E? | throw E | break a? | continue a? | assert E | a E",
        "Stmt": "Ctrl* ( Simple? ';' | B.stmts ( Ctrl+ ( B.stmts | Simple? ';' ) )* | Class )",
        "Method": "Mod* Gen? Annot* ( Type a | a ) P.params I.index* ( throws Types )? ( B.stmts | ( default E )? ';' )",
        "Member": "Method | Var ';' | Class | static? B.stmts | ';'",
    }
    lang = Language(g, _tokens(_C_COMMENT, _OPEN_COMMENT, r'"""[\s\S]*?"""', _STRING, r"'(?:\\.|[^'\\\n])+'", _OPEN_STRING, _NUMBER, _WORD, _ops(_JAVA_OPS), r"\S"))
    lang.goes_on = lang.chars(";", ",", ".", ")", "else", "catch", "finally", "::")
    lang.set_rules(
        {
            "(": {
                "args": ("list", "( a '=' )? ( E | Annot | B.list )"),
                "params": ("list", "Mod* Type ( '|' Type )* ( '...' )? ( a | this )? I.index* | a"),
                "for": ("semi", "( Var | E ( ',' E )* | Mod* Type a ':' E )?"),
                "try": ("semi", "Var | E"),
            },
            "[": {"index": ("list", "E")},
            "{": {
                "stmts": ("run", "Stmt"),
                "members": ("run", "Member"),
                "enum": ("whole", "( Annot* a P.args? B.members? ( ',' Annot* a P.args? B.members? )* ','? )? ( ';' Member* )?"),
                "list": ("list", "E | B.list | Annot"),
            },
        },
        "Annot* package a ( '.' a )* ';' | import static? a ( '.' a )* ( '.' '*' )? ';' | Class | ';'",
    )
    return lang


# ---------------------------------------------------------------- JavaScript and TypeScript
_JS_OPS = ">>>= ... === !== **= <<= >>= >>> &&= ||= ??= => ?. ?? ** ++ -- && || == != <= >= += -= *= /= %= &= |= ^= << >>"
_JS_WORDS = "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with yield let static async await of get set from as null true false"
_TS_WORDS = "type interface enum implements declare namespace module abstract readonly public private protected keyof satisfies is infer unique override asserts"


def js_language(typed: bool) -> Language:
    g = Grammar("ts" if typed else "js")
    g.declare(_JS_WORDS + (" " + _TS_WORDS if typed else ""), _JS_OPS, {
        "(": "for types params args", "[": "types list", "{": "names enum members cases types obj stmts",
    })
    t = typed
    soft = "async|await|of|get|set|from|as|let|static" + ("|type|interface|declare|namespace|module|abstract|readonly|keyof|satisfies|is|infer|unique|override|asserts|public|private|protected" if t else "")
    obj = "B.types/obj/stmts" if t else "B.obj/stmts"
    g.macros = {
        "Id": "a|" + soft,
        "Name": "'#'? ( a | " + "|".join(_JS_WORDS.split()) + ("|" + "|".join(_TS_WORDS.split()) if t else "") + " )",
        # types are runs of names and joining words, with brackets as cells
        "TName": f"a|{soft}|S|N|'`'|void|null|this|true|false|I.types/list|{obj}|P.types/params/args|import",
        "TJoin": "'|'|'&'|'.'|'=>'|is|extends|'?'|':'|in|typeof|keyof|readonly|infer|new|unique|asserts|abstract|'-'|'||'",
        "Gen": f"'<' ( a|{soft}|S|N|void|null|this|true|false|I.types/list|{obj}|P.types/params/args|'|'|'&'|'.'|'=>'|extends|'?'|':'|in|typeof|new|'-'|','|'='|'<'|'>'|'>>'|const )* ( '>' | '>>' )",
        "Type": "TJoin* TName ( TJoin+ TName | Gen ( '.' TName )? | I.types/list )*",
        "Ann": "( '?' | '!' )? ':' Type | '?'",
        "Bin": "'+'|'-'|'*'|'/'|'%'|'&'|'^'|'<'|'>'|'?'|':'|'='|'&&'|'||'|'=='|'!='|'==='|'!=='|'<='|'>='|'+='|'-='|'*='|'/='|'%='|'&='|'^='|'|='|'<<'|'>>'|'>>>'|'<<='|'>>='|'>>>='|'**'|'**='|'&&='|'||='|'??='|'??'|'|'|in|instanceof|of",
        "Pre": "'!'|'~'|'+'|'-'|'++'|'--'|'...'|typeof|void|delete|await|new|yield '*'?|async? ( Id | " + ("Gen? P.params Ann?" if t else "P.params") + " ) '=>'" + ("|Gen" if t else ""),
        "Head": "async? function '*'? Id? " + ("Gen? P.params Ann?" if t else "P.params") + " | class " + ("( TName | TJoin | ',' | '<' | '>' | '>>' | implements )*" if t else "( a | " + soft + " )? ( extends ( a | this | P.args | '.' | " + soft + " )+ )?"),
        "Post": "'.' Name | '?.' ( Name | P.args | I.list ) | P.args | I.list | '++' | '--' | '`'" + (" | '!' | Gen P.args | ( as | satisfies ) ( const | Type )" if t else ""),
        "Unit": "Pre* ( Head? B.members/obj/stmts | Id | N | S | '`' | '/' | P.args | this | super | null | true | false | I.list | import P.args | ( import | new ) '.' a ) Post*",
        "E": "Unit ( Bin Unit )*",
        "EL": "Unit ( ( Bin | ',' ) Unit )*",
        "Var": "( const | let | var ) " + ("( Id | I.list | " + obj + " ) Ann? ( ( '=' | of | in ) EL ( ':' Type '=' EL )* )?" if t else "EL"),
        "Typed": "( declare | abstract | const )* ( ( interface | type | enum | namespace | module ) ( Id | S ) ( '.' Id )* Gen? ( extends Type ( ',' Type )* )? ( '=' Type | B.names/enum/types/obj/stmts )? | Head B.members/types/obj/stmts? | ( let | var | const ) Id Ann )",
        "Simple": "EL | Var | return EL? | throw EL | break Id? | continue Id? | debugger" + (" | Typed" if t else "")
        + " | import ( type1 ( ( Id ',' )? ( Id | B.names/enum/types/obj/stmts | '*' as Id ) from )? S ( a B.obj/stmts )?" + (" | a '=' E" if t else "") + " )"
        + " | export ( default | type1 B.names/enum/types/obj/stmts ( from S )? | '*' ( as Name )? from S" + (" | '=' E" if t else "") + " )",
        "type1": "type?" if t else "a1*",
        "a1": "'\x02'",
        "Deco": "'@' Id ( '.' Name )* P.args?",
        "Ctrl": "if P.args | else | while P.args | for await? P.for | switch P.args | do | try | catch P.params? | finally | with P.args | Id ':' | export default? | Deco",
        "Stmt": "( Ctrl | B.cases/types/obj/stmts )* Simple? ';'?" if t else "( Ctrl | B.cases/obj/stmts )* Simple? ';'?",
        "Mods": "Deco|static|async|get|set|'*'" + ("|public|private|protected|readonly|abstract|declare|override" if t else ""),
        "Key": "Name | S | N | I.list",
        "Member": "Mods* ( Key " + ("( Ann | '!' )? ( Gen? P.params Ann? )? " if t else "P.params? ") + "( ( '=' E )? | " + ("B.types/obj/stmts" if t else "B.obj/stmts") + " ) | B.obj/stmts" + (" | I.types/list Ann" if t else "") + " )? ';'?",
        "TypeMember": "( readonly | get | set | new | '-' | '+' )* ( ( Key | I.types/list ) ( '?' | '-' '?' )? )? ( Gen? P.params )? ( ':' Type )?",
    }
    regex = r"(?<=[(,=:;!&|?{}\[+\n])[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"
    lang = Language(g, _tokens(r"\n", _C_COMMENT, _OPEN_COMMENT, regex, _STRING, r"'(?:\\.|[^'\\\n])*'", r"`(?:\\.|[^`\\])*`", r"'[^\n]*|`[\s\S]*", _OPEN_STRING, _NUMBER, r"[^\W\d$][\w$]*|\$[\w$]*", _ops(_JS_OPS), r"\S"))
    g.operators["\x02"] = "\x02"
    lang.ends_line = frozenset(["a", "0", '"', "`", "/", *lang.chars("++", "--", "break", "continue", "return", "debugger", "this", "super", "null", "true", "false", *soft.split("|"))])
    lang.joins_line = frozenset(".,;:?=+-*/%&|^<>)]}" + lang.chars("else", "catch", "finally", "instanceof", "in", "extends", *[o for o in _JS_OPS.split() if o not in ("++", "--")]) + (lang.chars("as", "satisfies", "implements") if t else ""))
    lang.goes_on = lang.chars(";", ",", ".", ")", "else", "catch", "finally", "=", "?.", "from", "?", ":", "|", "&", "||", "&&", "??", "==", "===", "!=", "!==", "+", "<", ">", "as", "instanceof", "in", "while", "extends") + (lang.chars("satisfies", "implements", "is") if t else "")
    never = "'\x02'"
    lang.set_rules(
        {
            "(": {
                "for": ("semi", "( Var | EL )?"),
                "types": ("list", "Type" if t else never),
                "params": ("list", "Deco* " + ("( public | private | protected | readonly )* " if t else "") + "'...'? ( Id | this | I.list | " + obj + " ) " + ("Ann? " if t else "") + "( '=' E )?"),
                "args": ("list", "E"),
            },
            "[": {
                "types": ("list", "( Id '?'? ( ':' | in ) )? '...'? Type" if t else never),
                "list": ("list", "E?"),
            },
            "{": {
                "names": ("list", "type1 ( Name | S ) ( as ( Name | S ) )?"),
                "enum": ("list", "( Name | S ) ( '=' E )?"),
                "members": ("run", "Member"),
                "cases": ("run", "( case EL ':' | default ':' )* Stmt"),
                "types": ("fields", "TypeMember" if t else never),
                "obj": ("list", "'...' E | ( async | get | set | '*' )* Key ( ':' E | " + ("Gen? P.params Ann? " if t else "P.params ") + "B.obj/stmts | '=' E )?"),
                "stmts": ("run", "Stmt"),
            },
        },
        "Stmt",
    )
    return lang


# ---------------------------------------------------------------- Rust
_RUST_OPS = "<<= >>= ..= ... :: -> => && || == != <= >= += -= *= /= %= &= |= ^= .."


def rust_language() -> Language:
    g = Grammar("rust")
    g.declare(
        "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type union unsafe use where while yield macro_rules",
        _RUST_OPS, {"(": "params types args any", "[": "types list any", "{": "use variants fields items init arms stmts any"},
    )
    anything = " | ".join(f"'{x}'" for x in [*_RUST_OPS.split(), *"+ - / % & ^ < > = ! . , ; : # $ @ ? ~ * |".split()])
    g.macros = {
        "Seg": "a|self|Self|super|crate|union|macro_rules",
        "TName": "a|self|Self|super|crate|union|P.types/args|I.types/list|'!'|L",
        "TJoin": "'&'|'&&'|'*'|mut|const|L|dyn|impl|'?'|'::'|'+'|'->'|for|fn|unsafe|extern|S|as",
        "Gen": "'<' ( TName | TJoin | N | ',' | ':' | '=' | '-' | B.stmts | '<' | '>' | '=>' )* '>'",
        "Type": "TJoin* ( TName | Gen ) ( TJoin+ TName | TJoin* Gen | L )*",
        "PName": "a|self|Self|super|crate|union|N|S|true|false|P.args|I.list|'..'|'..='",
        "PJoin": "'&'|'&&'|mut|ref|'|'|'@'|'..='|'..'|'-'|'::'|const",
        "Pat": "PJoin* PName ( PJoin+ PName | P.args | B.init/stmts | Gen | '!' P.any | '..' )*",
        "Mac": "'!' ( P.any/args | I.any/list | B.any/stmts )",
        "Closure": "( move | async | static )* ( '||' | '|' ( PName | '&' | '&&' | mut | ref | '@' | '::' | ':' | ',' | TName | TJoin | '<' | '>' | B.init/stmts )* '|' ) ( '->' Type )?",
        "Bin": "'+'|'-'|'*'|'/'|'%'|'&'|'^'|'<'|'>'|'='|'&&'|'||'|'=='|'!='|'<='|'>='|'+='|'-='|'*='|'/='|'%='|'&='|'^='|'|='|'<<='|'>>='|'<' '<'|'>' '>'|'|'|'..'|'..='|else",
        "Pre": "'&'|'&&'|'*'|'!'|'-'|mut|return|break L?|yield|if|match|while|loop|unsafe|async|move|const|for Pat in|let Pat '='|L ':'|'..'|'..='|Closure|Attr",
        "Unit": "Pre* ( a | self | Self | super | crate | union | N | S | true | false | P.args | I.list | B.init/arms/stmts | '::' Seg | Gen '::' Seg | return | break L? | continue L? | '..' ) ( '.' ( a | N | await ) | '::' ( Seg | Gen ) | P.args | I.list | '?' | as Type | Mac | B.init/arms/stmts )*",
        "E": "Unit ( Bin Unit )* ( '..' )?",
        "Attr": "'#' '!'? I.any/list/types",
        "Vis": "pub P.any/args?",
        "Where": "( where ( TName | TJoin | '<' | '>' | ':' | ',' | '=' )* )?",
        "Any": "ANY | L | P.any | I.any | B.any | " + anything,
        "Item": "Vis? ( use ( '::' | a | self | super | crate | Self | '*' | as | B.use/init/stmts/any )+ ';' | ( const | async | unsafe | extern S? )* fn a Gen? P.params ( '->' Type )? Where ( B.stmts | ';' )"
        " | ( struct | enum | union ) a Gen? Where ( B.fields/variants/stmts/init | P.types/args Where ';' | ';' ) | unsafe? ( impl Gen? | trait a Gen? ':'? ) ( Type ( for Type )? )? Where B.items/stmts/init"
        " | mod a ( ';' | B.items/stmts/init ) | ( const | static ) mut? a ':' Type ( '=' E )? ';' | type a Gen? ( ':' Type )? ( '=' Type )? Where ';' | macro_rules '!' a ( B.any/stmts | P.any ';' ) | extern crate a ( as a )? ';' | extern S? B.items/stmts | a ( '::' a )* Mac ';'? )",
        "Stmt": "Attr* ( let Pat ( ':' Type )? ( '=' E )? ';' | Item | E? ';'? )",
    }
    lang = Language(g, _tokens(_C_COMMENT, _OPEN_COMMENT, r'b?r(#*)"[\s\S]*?"\1', r'b?"(?:\\[\s\S]|[^"\\])*"', r"b?'(?:\\[^\n']+|\\'|[^\\'\n])'", r"'[^\W\d]\w*", r'"[\s\S]*', r"0[xbo][0-9a-fA-F_]+\w*|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?\w*(?:\.(?![.\w]))?", _WORD, _ops(_RUST_OPS), r"\S"))
    lang.goes_on = lang.chars(";", ",", ".", ")", "else", "?", "==", "!=", "=", "=>", "&&", "||", "+", "..", "as", ">", "<")
    lang.set_rules(
        {
            "(": {
                "params": ("list", "Attr* ( ( '&' L? )? mut? self ( ':' Type )? | Pat ':' Type | '...' | Type )"),
                "types": ("list", "Attr* Vis? ( a ':' )? Type"),
                "args": ("list", "Attr* Vis? ( a ':' )? ( E | Pat | Type )"),
                "any": ("whole", "Any*"),
            },
            "[": {"types": ("whole", "( Type ( ';' E )? | E )?"), "list": ("list", "( E | Pat ) ( ';' E )?"), "any": ("whole", "Any*")},
            "{": {
                "use": ("list", "( '::' | a | self | super | crate | '*' | as | B.use/init/stmts/any )+"),
                "variants": ("list", "Attr* a ( P.types/args | B.fields/init/stmts )? ( '=' E )?"),
                "fields": ("list", "Attr* Vis? a ':' Type"),
                "items": ("run", "Attr* ( Item | ';' )?"),
                "init": ("list", "Attr* ( ( a | N ) ( ':' ( E | Pat ) )? | '..' E? | ( ref | mut )+ a )"),
                "arms": ("arms", "Attr* Pat ( if E )? '=>' E"),
                "stmts": ("run", "Stmt"),
                "any": ("whole", "Any*"),
            },
        },
        "Attr* Item | Attr+ | ';'",
    )
    return lang


# ---------------------------------------------------------------- Go
_GO_OPS = "&^= <<= >>= ... := <- ++ -- && || == != <= >= += -= *= /= %= &= |= ^= << >> &^"


def go_language() -> Language:
    g = Grammar("go")
    g.declare(
        "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
        _GO_OPS, {"(": "args params decls", "[": "index", "{": "stmts cases lit fields iface"},
    )
    g.macros = {
        "Type": "( '*' | I.index | map I.index | chan | '<-' | '...' | '~' )* ( a ( '.' a )? I.index? | struct B.fields/stmts/lit | interface B.iface/stmts/lit | func P.params/args Result? | P.params/args )",
        "Result": "( '*' | I.index | map I.index | chan | '<-' )* ( a ( '.' a )? I.index? | struct B.fields/stmts/lit | interface B.iface/stmts/lit | func P.params | P.params/args )",
        "Bin": "'+'|'-'|'*'|'/'|'%'|'&'|'^'|'<'|'>'|'&&'|'||'|'=='|'!='|'<='|'>='|'<<'|'>>'|'&^'|'|'",
        "Pre": "'&'|'*'|'!'|'-'|'+'|'^'|'<-'",
        "Lit": "( '*' | I.index | map I.index )+ ( a ( '.' a )? | interface B.iface/stmts | struct B.fields/stmts ) | struct B.fields/stmts | map I.index Type | chan Type",
        "Unit": "Pre* ( a | N | S | P.args | func P.params/args Result? B.stmts | Lit ) ( '.' ( a | P.args/params ) | P.args | I.index | B.lit/stmts )*",
        "E": "Unit ( Bin Unit )*",
        "EL": "Unit ( ( Bin | ',' ) Unit )*",
        "Assign": "'='|':='|'+='|'-='|'*='|'/='|'%='|'&='|'|='|'^='|'<<='|'>>='|'&^='",
        "Simple": "EL ( Assign ( range? EL ) | '++' | '--' | '<-' E )?",
        "Spec": "a ( ',' a )* Type? ( '=' EL )?",
        "Decl": "( var | const ) ( Spec | P.decls ) | type ( a I.index? '='? Type | P.decls )",
        "Head": "( Simple? ';' )? Simple?",
        "For": "for ( Simple ( ';' E? ';' Simple? )? | ';' E? ';' Simple? | range E )?",
        "Stmt": "( a ':' )* ( ( ( else? if | switch ) Head B.stmts/cases | else B.stmts )+ | For B.stmts | select B.cases/stmts | B.stmts | return EL? | go E | defer E | break a? | continue a? | goto a | fallthrough | Decl | Simple )?",
        "Recv": "P.params/args",
    }
    lang = Language(g, _tokens(r"\n", _C_COMMENT, _OPEN_COMMENT, _STRING, r"`[^`]*`", r"'(?:\\[^\n']+|\\'|[^\\'\n])'", r"`[\s\S]*", _OPEN_STRING, _NUMBER, _WORD, _ops(_GO_OPS), r"\S"))
    lang.ends_line = frozenset(["a", "0", '"', *lang.chars("++", "--", "break", "continue", "fallthrough", "return")])
    lang.goes_on = "*"  # a block never ends a statement by itself: line breaks do
    lang.long_heads = lang.chars("for", "if", "switch")
    lang.set_rules(
        {
            "(": {
                "args": ("list", "E '...'? | Type | type"),
                "params": ("list", "a? Type | a"),
                "decls": ("run", "Spec | a I.index? '='? Type | ( a | '.' )? S"),
            },
            "[": {"index": ("whole", "( E? ':' E? ( ':' E? )? | EL ','? | Type ( ',' Type )* | '...' | ( a Type ','? )+ )?")},
            "{": {
                "stmts": ("run", "Stmt"),
                "cases": ("run", "( case ( Simple | Type ( ',' Type )* ) ':' | default ':' )* Stmt"),
                "lit": ("list", "( ( E | B.lit/stmts ) ':' )? ( E | B.lit/stmts )"),
                "fields": ("run", "( a ( ',' a )* Type S? | '*'? a ( '.' a )? I.index? S? )?"),
                "iface": ("run", "( a P.params/args Result? | Type ( '|' Type )* )?"),
            },
        },
        "( package a | import ( ( a | '.' )? S | P.decls ) | func Recv? a I.index? P.params/args Result? B.stmts? | Decl )?",
        "package a",
    )
    return lang


# ---------------------------------------------------------------- JSON
def json_language() -> Language:
    g = Grammar("json")
    g.declare("true false null", "", {"(": "none", "[": "list", "{": "obj"})
    g.macros = {"V": "S | N | true | false | null | I.list | B.obj"}
    lang = Language(g, _tokens(r'"(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})|[^"\\\x00-\x1f])*"', r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])", r"[^\W\d]\w*", r"[\x00-\x08\x0b\x0c\x0e-\x1f]", r"\S"), skip=())
    lang.set_rules({"(": {"none": ("whole", "V")}, "[": {"list": ("strict", "V")}, "{": {"obj": ("strict", "S ':' V")}}, "V")
    return lang


MAKERS = {"c": c_language, "java": java_language, "js": lambda: js_language(False), "ts": lambda: js_language(True), "rs": rust_language, "go": go_language, "json": json_language}
assert BROKEN
