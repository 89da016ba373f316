"""Script texts for the extraction tests."""

CASES = {
    "empty": "",
    "blank": "  \n ",
    "not_sql": "just some notes\non two lines",
    "table_only": "CREATE TABLE crate (id bigint);",
    "null": None,
    "qualified": "CREATE FUNCTION depot.load_crate(_crate bigint) RETURNS void LANGUAGE plpgsql AS $$ x $$;",
    "unqualified": "CREATE OR REPLACE FUNCTION tick() RETURNS void LANGUAGE plpgsql AS $$ x $$;",
    "overloads": """CREATE FUNCTION s.weigh(_w real, _unit text) RETURNS text LANGUAGE sql STABLE AS $$ 1 $$;
        CREATE FUNCTION s.weigh(_w real, _unit text, _round boolean) RETURNS text LANGUAGE sql AS $$ 2 $$;""",
    "commented_out": """/* a /* b CREATE FUNCTION ghost.f() RETURNS void */ it's still one */
        -- CREATE FUNCTION ghost.g() RETURNS void
        CREATE PROCEDURE depot.seen() LANGUAGE sql AS $$ 1 $$;""",
    "open_comment": "CREATE FUNCTION a() RETURNS int LANGUAGE c; /* CREATE FUNCTION b() RETURNS int LANGUAGE c;",
    "dynamic": """CREATE FUNCTION t.maker() RETURNS void LANGUAGE plpgsql AS $$
        execute 'CREATE FUNCTION t.made() RETURNS void LANGUAGE sql AS $q$ SELECT 1; $q$';
        COMMENT ON FUNCTION t.maker() IS 'not a statement';
        $$;""",
    "modes": "create procedure p(IN _a integer, out _b numeric, INOUT _c text, VARIADIC _d text[], in integer) language sql as $$ $$;",
    "unnamed": "CREATE FUNCTION depot.plus(integer, integer) RETURNS integer LANGUAGE sql AS 'SELECT $2 - $1 * 3';",
    "defaults": """CREATE FUNCTION f(_a integer DEFAULT 3, _b text DEFAULT NULL::text, _c jsonb DEFAULT '{}'::jsonb,
        IN _d text DEFAULT (upper(NULL)::text <> 'n'::text), _e numeric = 0, _f text[] = array['p','q']::text[],
        _g text = 'a,b -- c', _h integer[] = array[1,2], _i text
        DEFAULT 'x
        y', _j int default(coalesce(f(1,2),g(h(3)))), _k text = 'it''s =') RETURNS void LANGUAGE sql AS $$ $$;""",
    "multi_word": """CREATE FUNCTION f(character varying, _a double precision, timestamp without time zone,
        _b timestamp with time zone, bit varying(5)[], _c numeric(10,2)) RETURNS void LANGUAGE sql AS $$ $$;""",
    "deep_default": "CREATE FUNCTION f(_a int DEFAULT " + "(" * 40 + "1" + ")" * 40 + ", _b text) RETURNS void LANGUAGE sql AS $$ $$;",
    "setof": "create function f() returns setof record language sql as $$ $$;",
    "returns_array": "CREATE FUNCTION f() RETURNS integer[]\n LANGUAGE sql AS $$ $$;",
    "returns_table": "CREATE FUNCTION f() returns table(\n id integer,\n tags text[], at timestamp with time zone, n numeric(8,2)) LANGUAGE sql AS $$ $$;",
    "returns_line": "CREATE FUNCTION f() RETURNS trigger\n WINDOW;",
    "null_input_only": "CREATE FUNCTION f(OUT a int) RETURNS NULL ON NULL INPUT LANGUAGE sql AS $$ $$;",
    "attributes": """CREATE FUNCTION f() RETURNS SETOF integer
        ROWS 70 COST 8 STRICT PARALLEL
        RESTRICTED STABLE LANGUAGE sql WINDOW NOT LEAKPROOF TRANSFORM FOR TYPE hstore SUPPORT depot.s
        RETURNS NULL ON NULL INPUT CALLED ON NULL INPUT EXTERNAL SECURITY DEFINER nonsense
        SECURITY INVOKER SET search_path = depot SET lock_timeout TO '5s' SET a FROM CURRENT
        SET b = 'x, y' LEAKPROOF AS $$ $$ IMMUTABLE;""",
    "lower_attributes": "create function depot.quiet() returns void\n language plpgsql security definer\n as $$ $$;",
    "c_function": "CREATE FUNCTION f(internal) RETURNS internal LANGUAGE c WINDOW AS 'the_lib', 'the_symbol';",
    "no_body": "CREATE FUNCTION depot.ext(integer) RETURNS void\n LANGUAGE c;\nCREATE FUNCTION g() RETURNS int LANGUAGE sql AS $$ 1 $$;",
    "tags": """CREATE FUNCTION a() RETURNS boolean LANGUAGE plpgsql AS $outer$
        -- has $$ and /* in it
        RETURN substring($2 from $re$[\\t]+z$re$) is not null; $outer$;
        CREATE FUNCTION b() RETURNS int LANGUAGE sql AS $_7z$ 2 $_7z$;
        CREATE FUNCTION c() RETURNS int LANGUAGE sql AS $a$$b$ 'it $b$$a$;""",
    "quoted": """CREATE FUNCTION a() RETURNS text LANGUAGE sql AS 'SELECT ''"'' || _n || ''"''';
        CREATE FUNCTION b() RETURNS text LANGUAGE sql AS E'SELECT E''one\\ntwo''';
        CREATE FUNCTION c() RETURNS text LANGUAGE sql AS 'a--b';""",
    "atomic": """CREATE FUNCTION depot.plus(int, int) RETURNS int
        IMMUTABLE PARALLEL SAFE
        BEGIN ATOMIC;
          INSERT INTO depot.log VALUES (f(g($1)), 'x;y');
          SELECT CASE WHEN $1 > 0 THEN 1 END;
        END;
        CREATE FUNCTION depot.two() RETURNS int BEGIN ATOMIC SELECT 2; END;
        CREATE FUNCTION depot.none() RETURNS int BEGIN ATOMIC END;""",
    "long_bodies": "".join(
        f"CREATE FUNCTION f{i}() RETURNS int LANGUAGE sql AS $$ {i} {'x' * 500} $$;\n" for i in range(3)
    ),
    "no_returns_first": "CREATE PROCEDURE p(_id int)LANGUAGE sql AS $$ a $$;CREATE FUNCTION f(_a int,_b text DEFAULT 'x')RETURNS text LANGUAGE sql IMMUTABLE STRICT COST 5 AS $$ b $$;",
    "ragged": "\nCREATE\n\t or\tREPLACE\n  fUnCtIoN\tdepot.ragged  (\n\t_n\t\tBIGINT ,\n _word\n\n  TEXT\n default\t'w'\n)  RETURNS\n\n date\n Language\n\t SQL   Immutable Parallel\n\tSafe\nas\n$$\n 1 $$ ;\n",
    "comments": """CREATE FUNCTION depot.plus(a integer, b numeric(10,2)) RETURNS integer LANGUAGE sql AS $$ 1 $$;
        COMMENT ON FUNCTION depot.plus(integer, numeric(10,2)) IS 'old';
        comment on function depot.plus(a INTEGER, b numeric(10,2)) is 'It''s ; new';
        CREATE FUNCTION one() RETURNS int LANGUAGE sql AS $$ 1 $$;
        CREATE PROCEDURE depot.one() LANGUAGE sql AS $$ 1 $$;
        COMMENT ON PROCEDURE depot.one() IS 'proc'; COMMENT ON FUNCTION depot.one() IS 'other schema';
        CREATE FUNCTION bare() RETURNS int LANGUAGE sql AS $$ 1 $$; COMMENT ON FUNCTION bare() IS NULL;""",
    "quoted_name": 'CREATE FUNCTION depot."Odd Name"(_a int) RETURNS int LANGUAGE sql AS $$ 1 $$;',
    "quoted_names": """CREATE FUNCTION "Big Depot"."Odd ""N""ame"(_a int) RETURNS int LANGUAGE 'plpgsql' AS $$ 1 $$;
        CREATE PROCEDURE "plain" . h$1(_a int) LANGUAGE sql AS $$ 2 $$;
        COMMENT ON FUNCTION "Big Depot"."Odd ""N""ame"(int) IS 'odd'; COMMENT ON PROCEDURE plain.h$1(int) IS $c$tag$c$;
        CREATE FUNCTION a$b$c(_x int) RETURNS int LANGUAGE sql AS $_$ 3 $_$;""",
    "comment_forms": """CREATE FUNCTION k(_a int, OUT _b text) LANGUAGE sql AS $$ 1 $$;
        COMMENT ON FUNCTION k(int) IS 'by inputs'; COMMENT ON FUNCTION k(int, text) IS 'another one';
        CREATE FUNCTION l() RETURNS int LANGUAGE sql AS $$ 1 $$; COMMENT ON FUNCTION l() IS E'one\\n''two''\\\\';
        CREATE FUNCTION m() RETURNS int LANGUAGE sql AS $$ 1 $$; COMMENT ON FUNCTION m() IS 'gone'; COMMENT ON FUNCTION m() IS NULL;""",
    "unread": "CREATE FUNCTION (a int) RETURNS int; CREATE FUNCTION ok() RETURNS int LANGUAGE sql AS $$ 1 $$; COMMENT ON FUNCTION ok IS 'no list';",
    "lists": """CREATE FUNCTION f() RETURNS int LEAKPROOF SECURITY DEFINER SET search_path = public, "$user" , pg_temp
        SET lock_timeout TO '5s' SET b TO 'one', 'it''s two' COST 7 AS $$ 1 $$;
        CREATE FUNCTION g() RETURNS bigint RETURNS NULL ON NULL INPUT LANGUAGE internal AS 'int8in';
        CREATE FUNCTION h() RETURNS int RETURN 1 + 2;
        CREATE FUNCTION w() RETURNS SETOF int WINDOW LANGUAGE c AS 'lib', 'w_symbol';""",
    "quoted_type": 'CREATE FUNCTION f(_a "My Type") RETURNS "My Type" LANGUAGE sql AS $$ 1 $$;',
    "comment_behind_word": "CREATE FUNCTION/* note */ app.f() RETURNS int LANGUAGE sql AS $$ 1 $$;",
    "line_comment_behind_word": "CREATE PROCEDURE--note\napp.p() LANGUAGE sql AS $$ 1 $$;",
    "close_words": """CREATE FUNCTION/**/f(_a int) RETURNS int LANGUAGE sql AS $$ 1 $$; CREATE/**/FUNCTION g() RETURNS int LANGUAGE sql AS $$ 2 $$;
        CREATE FUNCTION"Foo"(int) RETURNS int LANGUAGE sql AS $$ 3 $$; CREATE OR/* x */REPLACE--y
PROCEDURE"s"."P"() LANGUAGE sql AS $$ 4 $$;
        COMMENT ON/**/FUNCTION f(int)IS'one'; COMMENT ON FUNCTION"Foo"(integer) IS 'of other types'; COMMENT ON PROCEDURE/**/s."P"() IS 'four';
        COMMENT/**/ON/**/FUNCTION/**/g()/**/IS/**/'two';""",
    "control_chars": "CREATE FUNCTION f(_a int) RETURNS int LANGUAGE sql AS $$ \x010\x02 $$; -- \x013\x02",
    "control_chars_outside": "CREATE FUNCTION f(_a \x03int, _b \x017\x02) RETURNS int LANGUAGE sql AS $$ 1 $$;",
    "garbage": "CREATE FUNCTION f(= 5, DEFAULT, , IN , a b c d, \"q\" \"t\") RETURNS LANGUAGE AS BEGIN ATOMIC SET COST; COMMENT ON FUNCTION f() IS ; CREATE FUNCTION g(( RETURNS",
    "unbalanced_before": "\\echo :( oops; CREATE FUNCTION f(_a numeric(1,2)) RETURNS int LANGUAGE sql AS $$ 1 $$;",
    "open_before": "\\echo ( oops\nCREATE FUNCTION f(_a numeric(1,2), _b int) RETURNS int LANGUAGE sql AS $$ 1 $$;",
    "rule_before": "CREATE RULE r AS ON INSERT TO t DO (a; b); CREATE FUNCTION f(_a int) RETURNS int LANGUAGE sql AS $$ 1 $$;",
}
