"""Schemas of the fact tables. Keys everywhere: repo_id, path."""

_SPAN = "start_line:int,end_line:int"
FACTS = {
    "symbols": f"array<struct<name:string,kind:string,{_SPAN},exported:boolean,is_type_only:boolean,parent:string,visibility:string>>",
    "imports": f"array<struct<specifier:string,kind:string,is_namespace:boolean,is_type_only:boolean,is_reexport:boolean,{_SPAN},names:array<struct<imported:string,local:string>>>>",
    "exports": f"array<struct<name:string,kind:string,source:string,is_type_only:boolean,{_SPAN}>>",
    "refs": "array<string>",
    "member_access": "array<string>",
    "markers": "array<struct<kind:string,dotted:string,on_symbol:string,value:string>>",
    "suppressions": "array<struct<rule:string,file_scoped:boolean,line:int,reason:string>>",
    "annotations": "array<struct<visibility:string,line:int,reason:string>>",
    "strings": "array<string>",
    "functions": f"array<struct<name:string,parent:string,{_SPAN},cyclomatic:int,cognitive:int,loc:int>>",
    "calls": f"array<struct<callee:string,{_SPAN}>>",
    "css_tokens": f"array<struct<name:string,{_SPAN}>>",
    "css_var_refs": "array<string>",
    "css_classes": f"array<struct<name:string,{_SPAN}>>",
    "css_class_refs": "array<string>",
    "loc": "int",
}
FACT_SCHEMA = "repo_id string, path string, content_hash long, " + ", ".join(f"{k} {v}" for k, v in FACTS.items())
FINDING_SCHEMA = "repo_id string, rule string, severity int, confidence int, symbol string, file string, start_line int, end_line int, message string, reason string, magnitude double"
MANIFEST_SCHEMA = "repo_id string, dir string, kind string, name string, dependencies array<string>, entries array<string>, base_url string, aliases array<struct<prefix:string,star:boolean,targets:array<string>>>"
