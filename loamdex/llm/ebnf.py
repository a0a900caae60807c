"""The grammars: tokens and rules of each language, written from the languages' own descriptions.

Words in quotes and in capitals are tokens. ID stands for a name, also for words that are keywords only in places; NAME for any word; NL for a line end
where one ends a statement.
"""

from __future__ import annotations

# ------------------------------------------------------------------------------------------------------------ JavaScript

SCRIPT_RESERVED = ("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with "
                   "null true false enum").split()
SCRIPT_WORDS = "let static async of get set as from await yield target meta accessor using".split()
TYPED_WORDS = ("interface namespace module type implements public private protected readonly abstract declare override keyof infer is satisfies asserts unique require global string number boolean any unknown never object symbol bigint undefined "
               "constructor out").split()

_BINARY = "'<' | '>' | '<=' | '>=' | '==' | '!=' | '===' | '!==' | '+' | '-' | '*' | '/' | '%' | '&' | '^' | '&&' | '||' | '??' | '<<' | '**' | 'in' | 'instanceof' | '|' | '>' '>' | '>' '>' '>'"
_ASSIGNS = "'=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '>' '>' '>=' | '**=' | '&&=' | '||=' | '??='"

SCRIPT = f"""
program = item*
item = imports | exports | stmt | NL
imports = 'import' (STR | clause 'from' STR) attributes? end
clause = ID (',' (star | named))? | star | named
star = '*' 'as' ID
named = '{{' (spec (',' spec)* ','?)? NL? '}}'
spec = (NAME | STR) ('as' (NAME | STR))?
attributes = ('with' | 'assert') object
exports = 'export' ('default' (named_function | anonymous_function | anonymous_class | decorators 'class' ID? class_rest | arrow_value end) | vars end | named_function | class_decl | named ('from' STR attributes?)? end | '*' ('as' (NAME | STR))? 'from' STR attributes? end)
anonymous_function = 'async'? 'function' '*'? signature block
anonymous_class = 'class' ID? class_rest
arrow_value = statement_assign
end = ';' | NL
block = '{{' (stmt | NL)* '}}'
stmt = block | vars end | named_function | class_decl | 'if' '(' expr ')' stmt ('else' stmt)? | 'for' 'await'? '(' for_head ')' stmt | 'while' '(' expr ')' stmt
  | 'do' stmt 'while' '(' expr ')' ';'? | 'switch' '(' expr ')' '{{' cases '}}' | 'try' block (catch ('finally' block)? | 'finally' block) | 'return' expr? end | 'throw' expr end
  | 'break' ID? end | 'continue' ID? end | 'debugger' end | 'with' '(' expr ')' stmt | ID ':' stmt | ';' | statement_assign (',' assign)* end
catch = 'catch' ('(' binding_target ')')? block
cases = ('case' expr ':' (stmt | NL)* | 'default' ':' (stmt | NL)*)* NL?
for_head = (vars | expr)? ';' expr? ';' expr? | declares binding_target ('of' assign | 'in' expr) | unary_only ('of' assign | 'in' expr)
declares = 'var' | 'let' | 'const' | 'using'
vars = declares binding (',' binding)*
binding = binding_target ('=' assign)?
binding_target = target
target = ID | array_pattern | object_pattern
array_pattern = '[' (element_pattern? ',')* element_pattern? NL? ']'
element_pattern = '...'? target ('=' assign)?
object_pattern = '{{' (property_pattern (',' property_pattern)* ','?)? NL? '}}'
property_pattern = '...' target | property_name ':' target ('=' assign)? | ID ('=' assign)?
named_function = 'async'? 'function' '*'? ID signature block
signature = params
params = '(' (param (',' param)* ','?)? NL? ')'
param = '...'? target ('=' assign)?
class_decl = decorators 'class' ID class_rest
class_rest = ('extends' heritage)? class_body
heritage = unary_only
decorators = ('@' unary_only NL?)*
class_body = '{{' (member | ';' | NL)* '}}'
member = decorators ('static' block | 'static'? ('async'? '*'? property_name signature block | ('get' | 'set') property_name signature block | 'accessor'? property_name ('=' assign)? end))
property_name = NAME | STR | NUM | PRIVATE | '[' assign ']'
expr = assign (',' assign)*
assign = arrow | 'yield' '*'? assign? | binary ('?' assign ':' assign)? (({_ASSIGNS}) assign)?
statement_assign = arrow | 'yield' '*'? assign? | statement_binary ('?' assign ':' assign)? (({_ASSIGNS}) assign)?
arrow = 'async'? (ID | signature) '=>' (block | assign)
binary = unary (({_BINARY}) unary)*
statement_binary = statement_unary (({_BINARY}) unary)*
unary = prefix* primary postfix*
unary_only = prefix* primary postfix*
statement_unary = prefix+ primary postfix* | plain_primary postfix*
prefix = '!' | '~' | '+' | '-' | 'typeof' | 'void' | 'delete' | 'await' | '++' | '--' | 'new'
postfix = '.' (NAME | PRIVATE) | '?.' (NAME | PRIVATE | '[' expr ']' | args | TPL) | '[' expr ']' | args | TPL | '++' | '--'
args = '(' (argument (',' argument)* ','?)? NL? ')'
argument = '...'? assign
plain_primary = ID | NUM | STR | TPL | 'this' | 'super' | 'null' | 'true' | 'false' | PRIVATE | array | '(' expr NL? ')' | 'import' ('.' 'meta' | args) | 'new' '.' 'target' | JSX
primary = plain_primary | object | function | 'class' ID? class_rest
function = 'async'? 'function' '*'? ID? signature block
array = '[' (argument? ',')* argument? NL? ']'
object = '{{' (property (',' property)* ','?)? NL? '}}'
property = '...' assign | property_name ':' assign | ID ('=' assign)? | 'async'? '*'? property_name signature block | ('get' | 'set') property_name signature block
"""

#: What TypeScript adds or has in another form.
TYPED = f"""
imports = 'import' 'type'? (STR | clause 'from' STR) attributes? end | 'import' 'type'? ID '=' ('require' '(' STR ')' | entity) end
spec = 'type'? (NAME | STR) ('as' (NAME | STR))?
exports = 'export' ('default' (named_function | anonymous_function | 'abstract'? 'class' ID? class_rest | decorators 'abstract'? 'class' ID? class_rest | interface | statement_assign end) | declaration | 'type'? named ('from' STR attributes?)? end
  | 'type'? '*' ('as' (NAME | STR))? 'from' STR attributes? end | '=' expr end | 'as' 'namespace' ID end | imports)
anonymous_function = 'async'? 'function' '*'? signature (block | end)
declaration = 'declare'? (vars end | named_function | class_decl | interface | alias | enum | namespace)
interface = 'interface' ID type_params? ('extends' reference (',' reference)*)? object_type
alias = 'type' ID type_params? '=' type end
enum = 'const'? 'enum' ID '{{' (enum_member (',' enum_member)* ','?)? NL? '}}'
enum_member = property_name ('=' assign)?
namespace = ('namespace' | 'module') (entity | STR) (module_body | end) | 'global' module_body
module_body = '{{' item* '}}'
entity = ID ('.' NAME)*
stmt = block | declaration | 'if' '(' expr ')' stmt ('else' stmt)? | 'for' 'await'? '(' for_head ')' stmt | 'while' '(' expr ')' stmt
  | 'do' stmt 'while' '(' expr ')' ';'? | 'switch' '(' expr ')' '{{' cases '}}' | 'try' block (catch ('finally' block)? | 'finally' block) | 'return' expr? end | 'throw' expr end
  | 'break' ID? end | 'continue' ID? end | 'debugger' end | ID ':' stmt | ';' | statement_assign (',' assign)* end
catch = 'catch' ('(' binding_target ')')? block
binding_target = target '!'? (':' type)?
named_function = 'async'? 'function' '*'? ID signature (block | end)
signature = type_params? params (':' return_type)?
return_type = type
param = decorators modifier* '...'? (target | 'this') '?'? (':' type)? ('=' assign)?
modifier = 'public' | 'private' | 'protected' | 'readonly' | 'override' | 'static' | 'abstract' | 'declare' | 'accessor'
class_decl = decorators 'abstract'? 'class' ID class_rest
class_rest = type_params? ('extends' heritage type_args?)? ('implements' type (',' type)*)? class_body
member = decorators ('static' block | modifier* (index_signature end | 'async'? '*'? property_name '?'? signature (block | end) | ('get' | 'set') property_name signature (block | end) | property_name ('?' | '!')? (':' type)? ('=' assign)? end))
type_params = '<' type_param (',' type_param)* ','? '>'
type_param = ('const' | 'in' | 'out')* ID ('extends' type)? ('=' type)?
type_args = '<' type (',' type)* '>'
type = 'asserts' (ID | 'this') ('is' type)? | (ID | 'this') 'is' type | function_type | union ('extends' union '?' type ':' type)?
function_type = 'abstract'? 'new'? type_params? params '=>' type
union = ('|' | '&')? type_unary (('|' | '&') type_unary)*
type_unary = ('keyof' | 'unique' | 'readonly' | 'infer')* type_primary ('[' type? ']')* ('extends' union)?
type_primary = reference | STR | TPL | '-'? NUM | 'this' | 'void' | 'null' | 'true' | 'false' | object_type | '[' (tuple_element (',' tuple_element)* ','?)? NL? ']' | '(' type NL? ')' | 'typeof' (entity | 'this' ('.' NAME)* | 'import' '(' STR ')' ('.' NAME)*) type_args?
  | 'import' '(' STR (',' object)? ')' ('.' NAME)* type_args?
tuple_element = '...'? (NAME '?'? ':' '...'? type | type '?'?)
reference = ID ('.' NAME)* type_args?
object_type = '{{' (type_member (';' | ',' | NL) | NL)* '}}'
type_member = index_signature | ('readonly' | '+' | '-')* '[' ID 'in' type ('as' type)? ']' ('+' | '-')? '?'? (':' type)? | 'new'? signature | ('get' | 'set') property_name signature | 'readonly'? property_name '?'? (':' type)? | property_name '?'? signature
index_signature = ('readonly' | 'static')* '[' ID ':' type ']' (':' type)?
arrow = 'async'? (ID | signature) '=>' (block | assign)
binary = unary ((({_BINARY}) unary) | ('as' | 'satisfies') (type | 'const'))*
statement_binary = statement_unary ((({_BINARY}) unary) | ('as' | 'satisfies') (type | 'const'))*
prefix = '!' | '~' | '+' | '-' | 'typeof' | 'void' | 'delete' | 'await' | '++' | '--' | 'new' | '<' (type | 'const') '>'
postfix = '.' (NAME | PRIVATE) | '?.' (NAME | PRIVATE | '[' expr ']' | type_args? args | TPL) | '[' expr ']' | args | TPL | '++' | '--' | '!' | type_args
property = '...' assign | property_name ':' assign | ID ('=' assign)? | 'async'? '*'? property_name '?'? signature block | ('get' | 'set') property_name signature block
"""

# ------------------------------------------------------------------------------------------------------------------ Java

JAVA_RESERVED = ("if else for while do switch case default return throw break continue class interface enum new instanceof try catch finally import package extends implements throws public private protected static final abstract native "
                 "synchronized transient volatile strictfp assert void int long short byte char boolean float double this super null true false goto const").split()
JAVA_WORDS = "record sealed permits yield var when module requires exports opens uses provides to with open transitive non".split()

_JAVA_BINARY = "'<' | '>' | '<=' | '>=' | '==' | '!=' | '+' | '-' | '*' | '/' | '%' | '&' | '^' | '&&' | '||' | '|' | '<<' | '>' '>' | '>' '>' '>'"
_JAVA_ASSIGNS = "'=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '>' '>' '>='"

JAVA = f"""
program = (modifier* 'package' name ';')? (('import' 'static'? name ('.' '*')? ';') | ';')* (top_level* | module)
top_level = modifier* (type_declaration | method_or_field) | ';'
module = annotation* 'open'? 'module' name '{{' directive* '}}'
directive = ('requires' ('transitive' | 'static')* name | ('exports' | 'opens') name ('to' name (',' name)*)? | 'uses' name | 'provides' name 'with' name (',' name)*) ';'
name = ID ('.' ID)*
annotation = AT ('(' (annotation_value | annotation_pair (',' annotation_pair)*)? ')')?
annotation_pair = ID '=' annotation_value
annotation_value = conditional | annotation | '{{' (annotation_value (',' annotation_value)*)? ','? '}}'
modifier = annotation | 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed'
type_declaration = 'class' ID type_params? ('extends' type)? ('implements' types)? ('permits' types)? class_body
  | 'interface' ID type_params? ('extends' types)? ('permits' types)? class_body
  | 'enum' ID ('implements' types)? '{{' (constant (',' constant)*)? ','? (';' member*)? '}}'
  | 'record' ID type_params? '(' (component (',' component)*)? ')' ('implements' types)? class_body
  | '@' 'interface' ID class_body
component = modifier* type '...'? ID
constant = annotation* ID args? class_body?
types = type (',' type)*
type_params = '<' type_param (',' type_param)* '>'
type_param = annotation* ID ('extends' type ('&' type)*)?
type_args = '<' (type_arg (',' type_arg)*)? '>'
type_arg = annotation* '?' (('extends' | 'super') type)? | type
type = annotation* (PRIMITIVE | ID type_args? ('.' annotation* ID type_args?)*) dims
dims = (annotation* '[' ']')*
class_body = '{{' member* '}}'
member = ';' | 'static'? block | modifier* (type_declaration | method_or_field)
method_or_field = type_params? ((type | 'void') ID formals dims ('throws' types)? (block | ('default' annotation_value)? ';') | ID formals ('throws' types)? block) | type declarators ';' | ID block
formals = '(' (formal (',' formal)*)? ')'
formal = modifier* type annotation* '...'? (ID '.')? (ID | 'this') dims
declarators = declarator (',' declarator)*
declarator = ID dims ('=' initializer)?
initializer = expr | array_initializer
array_initializer = '{{' (initializer (',' initializer)*)? ','? '}}'
block = '{{' block_statement* '}}'
block_statement = modifier* (type declarators ';' | local_type) | statement
local_type = type_declaration
statement = block | ';' | 'if' '(' expr ')' statement ('else' statement)? | 'for' '(' for_head ')' statement | 'while' '(' expr ')' statement | 'do' statement 'while' '(' expr ')' ';' | switch ';'?
  | 'try' (block (catch+ ('finally' block)? | 'finally' block) | '(' resource (';' resource)* ';'? ')' block catch* ('finally' block)?) | 'return' expr? ';' | 'throw' expr ';' | 'yield' expr ';' | 'break' ID? ';' | 'continue' ID? ';'
  | 'synchronized' '(' expr ')' block | 'assert' expr (':' expr)? ';' | ID ':' statement | expr ';'
catch = 'catch' '(' modifier* type ('|' type)* ID ')' block
resource = modifier* type ID '=' expr | expr
for_head = (modifier* type declarators | expr (',' expr)*)? ';' expr? ';' (expr (',' expr)*)? | modifier* type ID ':' expr
switch = 'switch' '(' expr ')' '{{' (old_case* | new_case*) '}}'
old_case = label ':' block_statement*
new_case = label '->' (expr ';' | block | 'throw' expr ';')
label = 'case' case_item (',' case_item)* ('when' expr)? | 'default'
case_item = binary_case | pattern | 'default'
binary_case = conditional_case
conditional_case = binary ('?' expr ':' conditional_case)?
pattern = modifier* type ID | type '(' (pattern (',' pattern)*)? ')' ID?
expr = lambda | conditional (({_JAVA_ASSIGNS}) expr)?
lambda = (ID | formals | '(' ID (',' ID)* ')') '->' (block | expr)
conditional = binary ('?' expr ':' (lambda | conditional))?
binary = unary ((({_JAVA_BINARY}) (unary | cast_lambda)) | 'instanceof' 'final'? (pattern | type))*
cast_lambda = '(' type ('&' type)* ')' lambda
unary = prefix* primary postfix*
prefix = '+' | '-' | '!' | '~' | '++' | '--' | '(' type ('&' type)* ')'
postfix = '.' (type_args? ID args? | 'new' annotation* ID type_args? args class_body? | 'this' | 'class' | type_args? 'super' args? ) | '[' expr ']' | '++' | '--' | '::' type_args? (ID | 'new')
primary = NUM | STR | 'null' | 'true' | 'false' | 'this' args? | 'super' (args | '.' type_args? ID args? | '::' type_args? ID) | ID args? | '(' (expr | cast_lambda) ')' | '(' type ('&' type)* ')' lambda | switch | 'new' creator
  | (PRIMITIVE | ID type_args? ('.' ID type_args?)*) ('[' ']')* ('.' 'class' | '::' type_args? (ID | 'new')) | 'void' '.' 'class'
creator = type_args? annotation* (PRIMITIVE | ID type_args? ('.' annotation* ID type_args?)*) (args class_body? | ('[' expr ']')+ ('[' ']')* | ('[' ']')+ array_initializer)
args = '(' (expr_or_cast (',' expr_or_cast)*)? ')'
expr_or_cast = expr
"""

# -------------------------------------------------------------------------------------------------------------------- Go

GO_RESERVED = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()

_GO_BINARY = "'||' | '&&' | '==' | '!=' | '<' | '<=' | '>' | '>=' | '+' | '-' | '|' | '^' | '*' | '/' | '%' | '<<' | '>>' | '&' | '&^'"
_GO_ASSIGNS = "'=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^='"

#: In the head of a control statement a name before a brace begins the body, no literal.
_GO_EXPRESSIONS = f"""
expr@ = unary@ (({_GO_BINARY}) unary@)*
unary@ = ('+' | '-' | '!' | '^' | '*' | '&' | '<-')* primary@ postfix@*
postfix@ = '.' (ID | '(' (type | 'type') ')') | '[' expr_or_type (',' expr_or_type)* ','? ']' | '[' expr? ':' expr? (':' expr)? ']' | '(' (expr_or_type (',' expr_or_type)* '...'? ','?)? ')' #literal#
exprs@ = expr@ (',' expr@)*
simple@ = exprs@ (('++' | '--') | ({_GO_ASSIGNS} | ':=') exprs@ | '<-' expr@)?
"""

GO = """
program = NL* 'package' ID ends (('import' (import | '(' (import ends)* import? ')')) ends)* (top ends)* top?
ends = (NL | ';')+
import = (ID | '.')? STR
top = declaration | 'func' ('(' receiver? ')')? ID type_params? signature block?
receiver = param (',' param)* ','?
declaration = 'var' group_var | 'const' group_const | 'type' group_type
group_var = var | '(' ((var ends)* var)? ')' | '(' (var ends)* ')'
group_const = const | '(' ((const ends)* const)? ')' | '(' (const ends)* ')'
group_type = type_spec | '(' ((type_spec ends)* type_spec)? ')' | '(' (type_spec ends)* ')'
var = ids (type ('=' exprs)? | '=' exprs)
const = ids (type? '=' exprs)?
type_spec = ID (type_params | '=')? type
ids = ID (',' ID)*
type_params = '[' type_param (',' type_param)* ','? ']'
type_param = ids constraint
constraint = '~'? type ('|' '~'? type)*
signature = '(' params? ')' result?
params = param (',' param)* ','?
param = '...'? type | ID '...'? type
result = '(' params? ')' | type
type = type_name | '*' type | '[' ']' type | '[' (expr | '...') ']' type | 'map' '[' type ']' type | 'chan' '<-'? type | '<-' 'chan' type | 'func' signature | struct | interface | '(' type ')'
type_name = ID ('.' ID)? ('[' type (',' type)* ','? ']')?
struct = 'struct' '{' ((field ends)* field?) '}'
field = (ids type | '*'? type_name | '(' '*'? type_name ')') STR?
interface = 'interface' '{' (method ends)* method? '}'
method = ID signature | constraint
block = '{' statements '}'
statements = (statement? ends)* statement?
statement = declaration | ID ':' statement? | simple | 'return' exprs? | 'break' ID? | 'continue' ID? | 'goto' ID | 'fallthrough' | 'go' expr | 'defer' expr | block | if | switch | select | for
if = 'if' ((simple_c)? ';')? expr_c block ('else' (if | block))?
switch = 'switch' (simple_c? (';' | NL))? (simple_c)? '{' (case statements)* '}'
case = ('case' expr_or_type (',' expr_or_type)* | 'default') ':'
select = 'select' '{' (('case' simple | 'default') ':' statements)* '}'
for = 'for' (expr_c | simple_c? ';' expr_c? (';' | NL) simple_c? | (exprs_c ('=' | ':='))? 'range' expr_c)? block
expr_or_type = expr | type
literal = '{' (element (',' element)* ','?)? '}'
element = (expr | literal) (':' (expr | literal))?
primary_t = '[' ']' type | '[' (expr | '...') ']' type | 'map' '[' type ']' type | struct
""" + _GO_EXPRESSIONS.replace("@", "").replace("#literal#", "| literal") + _GO_EXPRESSIONS.replace("@", "_c").replace("#literal#", "") + """
primary = ID | NUM | STR | '(' expr_or_type ')' | 'func' signature block | primary_t literal? | 'chan' '<-'? type | 'interface' '{' (method ends)* method? '}' | 'func' signature
primary_c = ID | NUM | STR | '(' expr_or_type ')' | 'func' signature block | primary_t literal? | 'chan' type
"""

# --------------------------------------------------------------------------------------------------------------------- C

C_RESERVED = ("if else for while do switch case default return break continue goto sizeof struct union enum typedef static const volatile extern register inline restrict unsigned signed void int long short char float double auto "
              "_Bool _Noreturn _Static_assert _Atomic _Alignas _Alignof _Thread_local _Generic _Complex __attribute__ __inline __inline__ __restrict __restrict__ __extension__ __typeof__ typeof __asm__ asm __volatile__ __const __signed__ __builtin_va_arg __declspec").split()

_C_BINARY = "'<' | '>' | '<=' | '>=' | '==' | '!=' | '+' | '-' | '*' | '/' | '%' | '&' | '^' | '&&' | '||' | '|' | '<<' | '>>'"
_C_ASSIGNS = "'=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>='"

C = f"""
program = external*
external = ';' | specifiers (declarators? ';' | declarator old_style* block) | declarator old_style* block | macro_call ';'? | assertion | asm ';' | 'extern' STRS ('{{' external* '}}' | external)
macro_call = MACRO '(' macro_arguments ')'
macro_arguments = (assign | type_name)? (',' (assign | type_name)?)*
assertion = '_Static_assert' '(' assign ')' ';' | '_Static_assert' '(' assign ',' strings ')' ';'
old_style = specifiers declarators ';'
specifiers = other_specifier* type_specifier (other_specifier)*
local_specifiers = other_local* type_specifier other_local*
other_local = storage | qualifier | attribute
other_specifier = storage | qualifier | attribute | MACRO ('(' macro_arguments ')')?
storage = 'typedef' | 'static' | 'extern' | 'register' | 'auto' | 'inline' | '__inline' | '__inline__' | '_Noreturn' | '_Thread_local' | '__extension__' | '_Alignas' '(' (type_name | assign) ')' | '__declspec' '(' macro_arguments ')'
qualifier = 'const' | 'volatile' | 'restrict' | '__restrict' | '__restrict__' | '_Atomic' | '__volatile__' | '__const'
attribute = '__attribute__' '(' '(' macro_arguments ')' ')'
type_specifier = size size_q* base? size_q* | base size_q* | ID | ('struct' | 'union') attribute* (ID attribute*)? fields? attribute* | 'enum' attribute* ID? ('{{' enumerator (',' enumerator)* ','? '}}')? attribute* | ('__typeof__' | 'typeof') '(' (expr | type_name) ')' | '_Atomic' '(' type_name ')'
size = 'unsigned' | 'signed' | 'short' | 'long' | '__signed__' | '_Complex'
size_q = size | qualifier
base = 'int' | 'char' | 'float' | 'double' | 'void' | '_Bool'
fields = '{{' (field | ';' | macro_call ';'? | assertion)* '}}'
field = specifiers (field_declarator (',' field_declarator)*)? ';'
field_declarator = declarator (':' conditional)? attribute* | ':' conditional
enumerator = ID attribute* ('=' conditional)?
declarators = init_declarator (',' init_declarator)*
init_declarator = declarator ('=' initializer)?
declarator = pointer* attribute* (ID | '(' attribute* declarator ')') declarator_end* (asm | attribute | macro_tail)*
macro_tail = MACRO ('(' macro_arguments ')')?
pointer = '*' (qualifier | attribute)*
declarator_end = '[' ('static' | qualifier)* (assign | '*')? ']' | '(' parameters? ')'
parameters = parameter (',' parameter)* (',' '...')? | '...'
parameter = specifiers (declarator | abstract)?
abstract = pointer+ abstract_end* | pointer* '(' abstract ')' abstract_end* | abstract_end+
abstract_end = '[' ('static' | qualifier)* (assign | '*')? ']' | '(' parameters? ')'
type_name = (size | base | qualifier | attribute | ID | ('struct' | 'union' | 'enum') ID? fields? | ('__typeof__' | 'typeof') '(' (expr | type_name) ')')+ abstract?
initializer = assign | '{{' (designated (',' designated)* ','?)? '}}'
designated = (('.' ID | '[' conditional ('...' conditional)? ']')+ '=' | ID ':')? initializer
block = '{{' block_item* '}}'
block_item = declaration | statement
declaration = local_specifiers declarators? ';' | assertion
statement = block | ';' | 'if' '(' expr ')' statement ('else' statement)? | 'for' '(' (declaration | expr? ';') expr? ';' expr? ')' statement | 'while' '(' expr ')' statement | 'do' statement 'while' '(' expr ')' ';' | 'switch' '(' expr ')' statement
  | 'return' (expr | initializer)? ';' | 'break' ';' | 'continue' ';' | 'goto' (ID | '*' unary) ';' | 'case' conditional ('...' conditional)? ':' after_label | 'default' ':' after_label | ID ':' attribute* after_label | asm ';' | ID '(' macro_arguments ')' (block | statement_keyword) | expr ';'
statement_keyword = 'if' '(' expr ')' statement ('else' statement)? | 'return' expr? ';'
after_label = (declaration | statement)?
asm = ('asm' | '__asm__') ('volatile' | '__volatile__' | 'goto' | 'inline')* '(' STRS (':' (operand (',' operand)*)?)* ')'
operand = ('[' ID ']')? STRS ('(' expr ')')? | ID
expr = assign (',' assign)*
assign = conditional (({_C_ASSIGNS}) assign)?
conditional = binary ('?' expr? ':' conditional)?
binary = unary (({_C_BINARY}) unary)*
unary = prefix* primary postfix* | prefix* 'sizeof' (unary | '(' type_name ')' literal?) | prefix* '_Alignof' '(' type_name ')'
prefix = '+' | '-' | '!' | '~' | '*' | '&' | '++' | '--' | '&&' | '(' type_name ')' | '__extension__'
postfix = '.' ID | '->' ID | '[' expr ']' | '(' (argument (',' argument)*)? ')' | '++' | '--'
argument = assign | type_name
literal = '{{' (designated (',' designated)* ','?)? '}}' postfix*
primary = ID | NUM | strings | '(' expr ')' | '(' block ')' | '(' type_name ')' literal | '_Generic' '(' assign (',' ('default' | type_name) ':' assign)+ ')' | '__builtin_va_arg' '(' assign ',' type_name ')'
strings = MACRO? STRS (MACRO STRS?)*
"""

# ------------------------------------------------------------------------------------------------------------------ Ruby

RUBY_RESERVED = "if unless while until for in do end def class module begin rescue ensure else elsif case when then return yield and or not break next redo retry alias undef super self nil true false defined? BEGIN END".split()

_RUBY_BINARY = "'+' | '-' | '*' | '/' | '%' | '**' | '==' | '!=' | '===' | '=~' | '!~' | '<=>' | '<' | '>' | '<=' | '>=' | '&&' | '||' | '&' | '|' | '^' | '<<' | '>>' | '..' | '...'"
_RUBY_ASSIGNS = "'=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '&=' | '|=' | '^=' | '<<=' | '&&=' | '||='"

#: MIF and the like: an ``if`` behind an operand, which belongs to what is before it. BAR: the parameters of a block, with the bars around them. LABEL: a name and a colon. SYM: a symbol. QUOTED: a literal string.
RUBY = f"""
program = statements
ends = ('NL' | ';')+
statements = (statement? ends)* statement?
statement = plain (('MIF' | 'MUNLESS' | 'MWHILE' | 'MUNTIL' | 'MRESCUE') sentence)*
plain = 'alias' method_name method_name | 'undef' method_name (',' method_name)* | ('BEGIN' | 'END') '{{' statements '}}' | targets '=' values | sentence
targets = target (',' target?)+ | '*' place?
target = '*' place? | place | '(' targets ')'
place = (ID | 'self' | '::' CONST) place_tail*
place_tail = ('.' | '&.' | '::') called parens? | '[' arguments? ']'
values = item (',' item)*
item = ('*' | '**')? expr
sentence = negated (('and' | 'or') negated)*
negated = 'not'* expr
expr = binary ('?' expr ':' expr | '?' expr SYM)? (({_RUBY_ASSIGNS}) right)? ('in' pattern | '=>' pattern)?
right = values ('MRESCUE' expr)?
binary = unary (({_RUBY_BINARY}) unary)* ('..' | '...')?
unary = ('!' | '-' | '+' | '~' | '&' | 'defined?' | '..' | '...' | 'not')* value
value = head tail*
head = name call? | literal | '(' statements ')' | '[' arguments? ']' | hash | 'self' | 'nil' | 'true' | 'false' | lambda | compound | ('return' | 'break' | 'next') command? | 'redo' | 'retry' | ('yield' | 'super') (parens | command)? | '::' CONST call? | '->' parens? block
name = ID
call = parens | command
parens = '(' arguments? ')'
literal = NUM | QUOTED+ | SYM | WORDS
tail = ('.' | '&.' | '::') (called (parens | command)? | parens) | '[' arguments? ']' | block
called = NAME
block = '{{' BAR? statements '}}' | 'do' BAR? body 'end'
command = argument (',' argument)*
arguments = argument (',' argument)* ','?
argument = ('*' | '**' | '&') expr? | LABEL expr? | QUOTED ':' expr | expr ('=>' expr)? | '...' | statement_argument
statement_argument = 'not' expr
hash = '{{' (pair (',' pair)* ','?)? '}}'
pair = expr '=>' expr | LABEL expr? | QUOTED ':' expr | '**' expr
lambda = '->' ('(' parameters? ')' | parameters)? ('{{' statements '}}' | 'do' body 'end')
parameters = parameter (',' parameter)* ','?
parameter = ID ('=' expr)? | '*' ID? | '**' (ID | 'nil')? | '&' ID? | LABEL expr? | '...' | '(' parameters ')'
body = statements rescues
rescues = ('rescue' rescued? then_or_ends statements)* ('else' statements)? ('ensure' statements)?
rescued = (item (',' item)*)? ('=>' value)?
then_or_ends = ends 'then'? | 'then'
compound = 'if' sentence then_or_ends statements ('elsif' sentence then_or_ends statements)* ('else' statements)? 'end' | 'unless' sentence then_or_ends statements ('else' statements)? 'end'
  | ('while' | 'until') sentence ('DOL' | ends) statements 'end' | 'for' target (',' target)* 'in' sentence ('DOL' | ends) statements 'end' | 'begin' body 'end'
  | 'case' sentence? ends? ('when' item (',' item)* then_or_ends statements)+ ('else' statements)? 'end' | 'case' sentence ends? ('in' top_pattern (('MIF' | 'MUNLESS') sentence)? then_or_ends statements)+ ('else' statements)? 'end'
  | 'def' defined ('(' parameters? ')' | parameters ends)? ends? body 'end' | 'DEFE' defined ('(' parameters? ')')? '=' statement
  | 'class' path ('<' expr)? ends body 'end' | 'class' '<<' expr ends body 'end' | 'module' path ends body 'end'
path = '::'? CONST ('::' CONST)*
defined = (('self' | ID) '.')? method_name
method_name = (NAME | 'self') '='? | SYM | '+' | '-' | '*' | '/' | '%' | '**' | '==' | '!=' | '===' | '=~' | '!~' | '<=>' | '<' | '>' | '<=' | '>=' | '!' | '~' | '&' | '|' | '^' | '<<' | '>>' | '+@' | '-@' | '[' ']' '='? | '`'
top_pattern = pattern_item (',' pattern_item)* ','?
pattern_item = '*' ID? | '**' (ID | 'nil') | LABEL pattern? | pattern
pattern = pattern_one ('|' pattern_one)* ('=>' ID)?
pattern_one = '^' (ID | '(' expr ')') | CONST ('::' CONST)* ('(' top_pattern? ')' | '[' top_pattern? ']')? | '[' top_pattern? ']' | '{{' top_pattern? '}}' | '(' pattern ')' | ID | 'nil' | 'true' | 'false' | 'self' | literal | '-'? NUM (('..' | '...') ('-'? NUM)?)? | literal ('..' | '...') literal?
"""
