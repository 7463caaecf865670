"""Schemas of the relational tables, as DDL."""

SCHEMAS = {
    "translation": "id int, english string, chinese string, dutch string, category string, user_id int, is_public boolean, created_at timestamp, updated_at timestamp",
    "users": "id int, username string, email string, first_name string, last_name string, display_name string, sso_provider string, sso_subject string, last_login timestamp, role_id int, status string, register_time timestamp, approve_time timestamp, approve_user_id int",
    "role": "id int, name string",
    "permission": "id int, name string, description string",
    "role_permissions": "role_id int, permission_id int",
    "stop_words": "id int, word string, created_at timestamp, user_id int",
    "upload_records": "id int, user_id int, filename string, stored_filename string, file_path string, file_size int, upload_time timestamp, status string, error_message string",
    "ingredient": "id int, food_name string, ingredient string, path string, created_at timestamp, updated_at timestamp",
}
CATALOGUE = "map<string,struct<ingredient:string,path:string,detail_url:string>>"
IMAGE = "struct<filename:string,filepath:string,shape_id:int,left:bigint,top:bigint,width:bigint,height:bigint,content_type:string,original_format:string,file_size:bigint,all_text:map<string,string>,translated_text:map<string,string>>"
OCR_MAPPING = f"map<string,struct<slide_number:int,images:array<{IMAGE}>>>"
ANNOTATIONS = "struct<timestamp:string,user:string,annotations:array<struct<page:int,type:string,coords:struct<left:double,top:double,width:double,height:double>,content:string,text:string,ocrResult:string,translation:string>>>"
CONTENT_LIST = "array<struct<type:string,text:string>>"
