"""Java queries.  Input: four source files per customer, service body by number % 10."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from stmtlens.catalog.base import fill, pick, spread, sql_values, table
from stmtlens.functions import derived as de
from stmtlens.operators import java as jv
from stmtlens.session import cut_lineage

SERVICE = "src/main/java/com/acme/app/S{k}.java"
REPOSITORY = "src/main/java/com/acme/data/OrderRepository.java"
BASES = "src/main/java/com/acme/data/BaseRepo.java"
ENTITY = "src/main/java/com/acme/model/Customer.java"

_FRAME = """package com.acme.app;

import com.acme.data.OrderRepository;
import static com.acme.model.Names.*;

/* class Fake { } */
@Service
public class S{k} extends Base<String> implements Runner, java.io.Closeable {
    private final OrderRepository orders;
    @Inject(required = false) private AuditRepository audit;

    public S{k}(OrderRepository orders) {
        this.orders = orders;
    }

{body}
}
"""
# The first line of a body is line 16 of its file.
BODIES = [
    """    public void run(List<Customer> customers) {
        for (Customer customer : customers) {
            orders.findByCustomerId(customer.getId());
        }
    }""",
    """    void run() {
        for (Order o : orders.findAll()) {
            use(o, "for (;;) { orders.findAll(); }");
        }
    }""",
    """    void run(List<Long> ids) {
        ids.forEach(id -> orders.findByCustomerId(id));
    }""",
    """    void run(List<Long> ids) {
        ids.stream().filter(x -> x > 0).map((Long id) -> {
            return this.orders.findByCustomerId(7);
        }).toList();
    }""",
    """    void run(Optional<Long> opt) {
        opt.map(id -> orders.findByCustomerId(id));
    }""",
    """    void run(int n, Iterator<Order> it) {
        for (int i = 0; i < n; i++)
            while (it.hasNext()) {
                audit.findByOwner(it.next(), "orders.findAll()"); // orders.x()
            }
        do { n--; } while (orders.count() > n);
    }""",
    """    void run(List<Long> ids, Map<String, Long> m) {
        ids.forEach(orders::findByCustomerId);
        m.forEach((a, b) -> helper.findByCustomerId(a));
        // for (;;) orders.findAll();
    }""",
    """    void run(List<Long> ids, OrderRepository given) {
        int n = 0;
        var local = this.orders;
        OrderRepository other = lookup();
        for (Long id : ids) { local.findByCustomerId(id); other.findAll(); given.findByCustomerId(n); }
    }""",
    """    void run(List<Long> ids, AuditRepository orders) {
        for (Long id : ids) orders.findByOwner(id);
    }""",
    """    void run(List<Customer> cs) {
        for (final Customer c : cs) {
            c.getOrders().size(); c.getRegion(); c.getName(); c.getAgent();
        }
    }""",
]
_REPOSITORY = '''package com.acme.data;

public interface OrderRepository extends BaseRepo<Order, Long> {
    // @Query("SELECT nope")
    @Query("SELECT o FROM Order o WHERE o.c = \\"x\\" AND o.id = {k}")
    List<Order> findCustom(Long id);

    List<Order> findByCustomerId(Long id);

    @Query(nativeQuery = true, value = """
        SELECT *
        FROM orders
        """)
    @Modifying
    List<Order> findByNative(String a);
    @Query("SELECT " + "x")
    Order findByBroken(String a);
    long countByStatusInAndTotalGreaterThan(List<String> s, int t);
    default Order first() { return findByX(1); }
    Order findByAddress_City(String c);
}
'''
_BASES = """package com.acme.data;
@Repository interface Marked { }
public interface BaseRepo<T, I> extends JpaRepository<T, I> { }
class OrderRepositoryImpl implements JpaRepository<Order, Long> { }
interface Sub extends OrderRepository { }
interface Lonely { Object type = Sub.class; }
"""
_ENTITY = """package com.acme.model;
@Entity
@Table(name = "customers_{k}", schema = "x")
public class Customer {
    @OneToMany(mappedBy = "customer")
    private List<Order> orders = new ArrayList<>();
    @ManyToOne(fetch = FetchType.LAZY) private Region region;
    @ManyToOne private Agent agent;
    @ManyToMany(fetch = FetchType.EAGER)
    Set<Tag> tags;
    @Column(name = "n") private String name;
    public String getName() { return name; }
}
"""


def java_sources(spark, folder):
    c = spread(table(spark, folder, "customer").select("c_custkey"), "c_custkey")
    k = F.col("c_custkey")
    file = lambda path, text: F.struct(fill(F.lit(path), k=k).alias("path"), text.alias("content"))
    service = fill(fill(F.lit(_FRAME), body=pick(k, BODIES)), k=k)
    files = F.array(
        file(SERVICE, service), file(REPOSITORY, fill(F.lit(_REPOSITORY), k=k)),
        file(BASES, F.lit(_BASES)), file(ENTITY, fill(F.lit(_ENTITY), k=k)),
    )
    return c.select(
        F.concat(F.lit("c"), k.cast("string")).alias("repo"), F.explode(files).alias("_f")
    ).select("repo", "_f.*")


_BUILT: dict[tuple[str, str], jv.JavaFacts] = {}


def _facts(spark, folder):
    """One set of fact tables per session and input, as an audit job would build them."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _BUILT:
        _BUILT[key] = jv.JavaFacts(cut_lineage(java_sources(spark, folder)))
    return _BUILT[key]


def tokens(spark, folder):
    return jv.java_tokens(java_sources(spark, folder), columns="depth bigint, line int").groupBy("repo", "path").agg(
        F.count("*").alias("n_tokens"), F.max("depth").alias("deepest"), F.max("line").alias("last_line")
    )


def _token_facts(text):
    """(tokens, deepest bracket, line of the last token) of a file, by a lexer of its own for what the files hold."""
    blank = lambda m: "\n" * m[0].count("\n") + " "
    # Comments and literals go together: either may hold the other's mark.
    text = re.sub(r'"""[\s\S]*?"""|"(?:\\.|[^"\\\n])*"|//[^\n]*|/\*[\s\S]*?\*/', blank, text.replace("{k}", "1"))
    found = list(re.finditer(r"[A-Za-z_$][\w$]*|\d[\w.]*|->|::|--|\+\+|&&|\S", text))
    depth = deepest = 0
    for m in found:
        depth -= m[0] in ")]}"
        deepest = max(deepest, depth)
        depth += m[0] in "([{"
    return len(found), deepest, 1 + text.count("\n", 0, found[-1].start())


def _token_rows():
    rows = [(t, SERVICE, *_token_facts(_FRAME.replace("{body}", body))) for t, body in enumerate(BODIES)]
    rest = [(REPOSITORY, _REPOSITORY), (BASES, _BASES), (ENTITY, _ENTITY)]
    return rows + [(None, path, *_token_facts(text)) for path, text in rest]


def types(spark, folder):
    return _facts(spark, folder).types.select(
        "repo", "path", "name", "kind", "line", F.array_join("supertypes", ",").alias("supertypes"),
        "first_argument", F.array_join("annotations", ",").alias("annotations"),
    )


_TYPES = sql_values(
    [
        (SERVICE, "S{k}", "class", 8, "Base,Runner,Closeable", "String", "Service"),
        (REPOSITORY, "OrderRepository", "interface", 3, "BaseRepo", "Order", ""),
        (BASES, "Marked", "interface", 2, "", None, "Repository"),
        (BASES, "BaseRepo", "interface", 3, "JpaRepository", "T", ""),
        (BASES, "OrderRepositoryImpl", "class", 4, "JpaRepository", "Order", ""),
        (BASES, "Sub", "interface", 5, "OrderRepository", None, ""),
        (BASES, "Lonely", "interface", 6, "", None, ""),
        (ENTITY, "Customer", "class", 4, "", None, "Entity,Table"),
    ],
    "path, name, kind, line, supertypes, first_argument, annotations",
)


def methods(spark, folder):
    return _facts(spark, folder).methods.select(
        "repo", "path", "name", "line", "declaring_type", F.col("body_start").isNotNull().alias("has_body")
    )


_METHODS = sql_values(
    [
        (SERVICE, "S{k}", 12, "S{k}", True), (SERVICE, "run", 16, "S{k}", True),
        *[(REPOSITORY, n, line, "OrderRepository", n == "first") for n, line in (
            ("findCustom", 6), ("findByCustomerId", 8), ("findByNative", 15), ("findByBroken", 17),
            ("countByStatusInAndTotalGreaterThan", 18), ("first", 19), ("findByAddress_City", 20))],
        (ENTITY, "getName", 12, "Customer", True),
    ],
    "path, name, line, declaring_type, has_body",
)


def repositories(spark, folder):
    return _facts(spark, folder).repositories


def handles(spark, folder):
    return _facts(spark, folder).handles.select(
        "repo", "path", "identifier", "repository_type", "injection", "line"
    )


_HANDLES = sql_values(
    [
        *[(t, "orders", "OrderRepository", "field", 9) for t in range(10)],
        *[(t, "audit", "AuditRepository", "field", 10) for t in range(10)],
        *[(t, "orders", "OrderRepository", "constructor-parameter", 12) for t in range(10)],
        (7, "given", "OrderRepository", "method-parameter", 16),
        (7, "local", "OrderRepository", "local-variable", 18),
        (7, "other", "OrderRepository", "local-variable", 19),
        (8, "orders", "AuditRepository", "method-parameter", 16),
    ],
    "t, identifier, repository_type, injection, line",
)


def iterations(spark, folder):
    return _facts(spark, folder).iterations.select(
        "repo", "path", "iteration_kind", "line", "element", "element_type", "iterable"
    )


_ITERATIONS = sql_values(
    [
        (0, "enhanced-for", 17, "customer", "Customer", "customers"),
        (1, "enhanced-for", 17, "o", "Order", "orders.findAll()"),
        (2, "lambda-for-each", 17, "id", None, None),
        (3, "lambda-stream", 17, "x", None, None),
        (3, "lambda-stream", 17, "id", None, None),
        (5, "for", 18, None, None, None), (5, "while", 18, None, None, None),
        (5, "do-while", 21, None, None, None),
        (6, "lambda-for-each", 18, None, None, None),
        (7, "enhanced-for", 20, "id", "Long", "ids"),
        (8, "enhanced-for", 17, "id", "Long", "ids"),
        (9, "enhanced-for", 17, "c", "Customer", "cs"),
    ],
    "t, iteration_kind, line, element, element_type, iterable",
)


def call_sites(spark, folder):
    return _facts(spark, folder).sites.select(
        "repo", "path", "line", F.col("identifier").alias("receiver"), "repository_type", "resolution", "injection",
        "method_name", "arguments", "enclosing_type", "enclosing_method",
        F.coalesce("nesting", F.lit(0)).alias("nesting"),
    )


# t, line, receiver, type, resolution, injection, method, arguments, nesting, dependency, element
SITES = [
    (0, 18, "orders", "OrderRepository", "declared", "field", "findByCustomerId", "customer.getId()", 1,
     "loop-element-argument", "customer"),
    (1, 17, "orders", "OrderRepository", "declared", "field", "findAll", "", 0, "no-arguments", None),
    (2, 17, "orders", "OrderRepository", "declared", "field", "findByCustomerId", "id", 1,
     "loop-element-argument", "id"),
    (3, 18, "orders", "OrderRepository", "declared", "field", "findByCustomerId", "7", 1, "independent", None),
    (4, 17, "orders", "OrderRepository", "declared", "field", "findByCustomerId", "id", 0, "independent", None),
    (5, 19, "audit", "AuditRepository", "name-convention", "field", "findByOwner",
     'it.next(), "orders.findAll()"', 2, "independent", None),
    (5, 21, "orders", "OrderRepository", "declared", "field", "count", "", 1, "no-arguments", None),
    (7, 20, "local", "OrderRepository", "declared", "local-variable", "findByCustomerId", "id", 1,
     "loop-element-argument", "id"),
    (7, 20, "other", "OrderRepository", "declared", "local-variable", "findAll", "", 1, "no-arguments", None),
    (7, 20, "given", "OrderRepository", "declared", "method-parameter", "findByCustomerId", "n", 1,
     "independent", None),
    (8, 17, "orders", "AuditRepository", "name-convention", "method-parameter", "findByOwner", "id", 1,
     "loop-element-argument", "id"),
]
_SITES = sql_values(
    SITES,
    "t, line, receiver, repository_type, resolution, injection, method_name, arguments, nesting, dependency, element",
)


def dependency(spark, folder):
    return _facts(spark, folder).sites.select(
        "repo", "line", F.col("identifier").alias("receiver"), "dependency", F.col("dependency_element").alias("element")
    )


def unresolved(spark, folder):
    facts = _facts(spark, folder)
    return jv.unresolved_types(facts.sites, facts.repositories)


def relations(spark, folder):
    """Lazy relations, with the mapped table of their entity."""
    facts = _facts(spark, folder)
    tables = jv.entity_tables(facts.types, facts.levels, facts.pieces)
    return facts.relations.join(tables, ["repo", "entity"], "left").select(
        "repo", "path", "entity", "field", "accessor", "association", "line", "table_name"
    )


def lazy(spark, folder):
    return _facts(spark, folder).lazy.select(
        "repo", "path", "line", F.col("identifier").alias("receiver"), "entity", "method_name", "field",
        "association", "enclosing_method", "nesting",
    )


def annotated(spark, folder):
    return _facts(spark, folder).queries.filter("symbol is null").select(
        "repo", "path", "id", "ordinal", "kind", "line", "text"
    )


def derived(spark, folder):
    return _facts(spark, folder).queries.filter("symbol is not null").select(
        "repo", "path", "id", "ordinal", "line", "text"
    )


_ANNOTATED = sql_values(
    [
        (1, "1", "jpql", 5, 'SELECT o FROM Order o WHERE o.c = "x" AND o.id = {k}'),
        (3, "3", "sql", 11, "        SELECT *\n        FROM orders\n        "),
    ],
    "ordinal, name, kind, line, text",
)
_DERIVED = sql_values(
    [
        (2, "findByCustomerId", 8, "SELECT *\nFROM order\nWHERE customer_id = ?"),
        (4, "findByNative", 15, "SELECT *\nFROM order\nWHERE native = ?"),
        (5, "countByStatusInAndTotalGreaterThan", 18,
         "SELECT COUNT(*)\nFROM order\nWHERE status IN (?)\nAND total > ?"),
    ],
    "ordinal, name, line, text",
)


def method_query(spark, folder):
    facts = _facts(spark, folder)
    return jv.method_queries(facts.methods, facts.types, facts.queries, facts.repositories).select(
        "repo", "path", "repository_type", "name", "line", "query_id"
    )


_METHOD_QUERIES = sql_values(
    [("findCustom", 6, "1"), ("findByCustomerId", 8, "findByCustomerId"), ("findByNative", 15, "3"),
     ("findByBroken", 17, None),
     ("countByStatusInAndTotalGreaterThan", 18, "countByStatusInAndTotalGreaterThan"),
     ("first", 19, None), ("findByAddress_City", 20, None)],
    "name, line, query",
)


def imports(spark, folder):
    """Where would the service find its repository types and a third one?"""
    facts = _facts(spark, folder)
    found = jv.package_imports(facts.levels, facts.pieces)
    wanted = facts.files.filter(F.col("path").contains("/app/")).select(
        "repo", "path", F.explode(F.array(F.lit("OrderRepository"), F.lit("AuditRepository"))).alias("type_name")
    )
    return jv.import_paths(wanted, found)


def spans(spark, folder):
    """Nested spans from events: event e spans 3, 9 and 27 ids around it; which hold its id?"""
    e = table(spark, folder, "events").select("event_id", "user_id")
    k = F.col("event_id")
    file = [F.lit("r").alias("repo"), F.concat(F.lit("f"), (F.col("user_id") % 50).cast("string")).alias("path")]
    size = F.explode(F.array(F.lit(3), F.lit(9), F.lit(27)))
    around = e.select(*file, "event_id", size.alias("size")).select(
        "repo", "path", (F.floor(F.col("event_id") / F.col("size")) * F.col("size")).alias("start"),
        (F.floor(F.col("event_id") / F.col("size")) * F.col("size") + F.col("size")).alias("end"), "size",
    ).distinct()
    points = e.select(*file, k.alias("off"))
    pairs = jv.containing(points, around)
    return pairs.groupBy("repo", "path", "off").agg(
        F.count("*").alias("nesting"), F.min_by("start", F.col("end") - F.col("start")).alias("innermost")
    )


def handle_scopes(spark, folder):
    """Handles scoped to spans of 9 and 27 ids; the narrowest one around the point wins."""
    e = table(spark, folder, "events").select("event_id", "user_id", "event_type")
    k = F.col("event_id")
    file = [F.lit("r").alias("repo"), F.concat(F.lit("f"), (F.col("user_id") % 50).cast("string")).alias("path")]
    points = e.select(*file, k.alias("off"), F.col("event_type").alias("identifier"))
    scope = lambda size: (F.floor(k / size) * size)
    handles = e.filter(k % 5 < 3).select(
        *file, F.col("event_type").alias("identifier"),
        F.explode(F.array(
            F.struct(scope(9).alias("start"), (scope(9) + 9).alias("end"), F.lit("narrow").alias("t")),
            F.struct(scope(27).alias("start"), (scope(27) + 27).alias("end"), F.lit("wide").alias("t")),
            F.struct(F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("end"), F.lit("global").alias("t")),
        )).alias("_s"),
    ).select("repo", "path", "identifier", F.col("_s.t").alias("repository_type"), F.lit("field").alias("injection"), "_s.start", "_s.end").distinct()
    return jv.resolve_handles(points, handles).select("path", "off", "identifier", "repository_type")


# --- derived method names: one per part ----------------------------------------------------------------

# name, operation, predicates as prop:op:conj:ic, order, limit, text
NAMES = [
    ("findByEmail", "find", "Email:equals::false", None, None, "SELECT *\nFROM {t}\nWHERE email = ?"),
    ("findTop3ByStatusAndTotalGreaterThanOrderByPlacedAtDesc", "find",
     "Status:equals::false|Total:greater_than:AND:false", "PlacedAt DESC", 3,
     "SELECT *\nFROM {t}\nWHERE status = ?\nAND total > ?\nORDER BY placed_at DESC\nLIMIT 3"),
    ("readFirstByNameIgnoreCaseOrCityIsNull", "find", "Name:equals::true|City:is_null:OR:false", None, 1,
     "SELECT *\nFROM {t}\nWHERE LOWER(name) = LOWER(?)\nOR city IS NULL\nLIMIT 1"),
    ("countByActiveTrueAndAgeBetween", "count", "Active:true::false|Age:between:AND:false", None, None,
     "SELECT COUNT(*)\nFROM {t}\nWHERE active = TRUE\nAND age BETWEEN ? AND ?"),
    ("existsByOrderIdNotIn", "exists", "OrderId:not_in::false", None, None,
     "SELECT 1\nFROM {t}\nWHERE order_id NOT IN (?)"),
    ("deleteByCreatedBefore", "delete", "Created:less_than::false", None, None,
     "DELETE\nFROM {t}\nWHERE created < ?"),
    ("removeByNameIsNot", "remove", "Name:not_equals::false", None, None, "DELETE\nFROM {t}\nWHERE name <> ?"),
    ("streamByAndroidNotLikeAndTagContaining", "find", "Android:not_like::false|Tag:containing:AND:false",
     None, None, "SELECT *\nFROM {t}\nWHERE android NOT LIKE ?\nAND tag LIKE ?"),
    ("getByIn", "find", "In:equals::false", None, None, "SELECT *\nFROM {t}\nWHERE in = ?"),
    ("findByStatusAllIgnoreCase", None, None, None, None, None),
    ("findByOrderByNameAsc", None, None, None, None, None),
    ("findByNameOrderBy", None, None, None, None, None),
    ("findByAddress_City", None, None, None, None, None),
    ("findAll", None, None, None, None, None),
    ("findByNameOr", "find", "NameOr:equals::false", None, None, "SELECT *\nFROM {t}\nWHERE name_or = ?"),
    ("findByOrName", None, None, None, None, None),
    ("queryByPriceLessThanEqualAndStockIsNotNull", "find",
     "Price:less_than_equal::false|Stock:is_not_null:AND:false", None, None,
     "SELECT *\nFROM {t}\nWHERE price <= ?\nAND stock IS NOT NULL"),
]


def _named(spark, folder):
    p = table(spark, folder, "part").select("p_partkey")
    k = F.col("p_partkey")
    types_ = ["OrderRepository", "OrderItemRepository", "Repository", "HTTPLog2Repository", "Customer"]
    return p.select(
        k.alias("id"), pick(k, [n[0] for n in NAMES]).alias("name"), pick(k, types_).alias("owner"),
    ).withColumn("query", de.decode_method(F.col("name")))


def decode(spark, folder):
    q = F.col("query")
    shown = F.array_join(
        F.transform(
            q["predicates"],
            lambda p: F.concat_ws(":", p["property"], p["operator"], F.coalesce(p["conjunction"], F.lit("")), p["ignore_case"].cast("string")),
        ), "|",
    )
    return _named(spark, folder).select(
        "id", q["operation"].alias("operation"), shown.alias("predicates"),
        F.when(q["order_property"].isNotNull(), F.concat_ws(" ", q["order_property"], q["order_direction"])).alias("ordering"),
        q["row_limit"].alias("row_limit"),
    )


def render(spark, folder):
    return _named(spark, folder).select(
        "id", de.render_method(F.col("query"), de.entity_table(F.col("owner"))).alias("text")
    )


def entity_names(spark, folder):
    return _named(spark, folder).select("id", de.entity_table(F.col("owner")).alias("table_name"))


_NAMES = sql_values([(n, *x[1:]) for n, x in enumerate(NAMES)], "t, operation, predicates, ordering, row_limit, text")
_OWNER_TABLE = """CASE p_partkey % 5 WHEN 0 THEN 'order' WHEN 1 THEN 'order_item' WHEN 2 THEN 'unknown_entity'
  WHEN 3 THEN 'httplog2' ELSE 'customer' END"""

QUERIES = {
    "java_tokens": tokens,
    "java_types": types,
    "java_methods": methods,
    "repository_closure": repositories,
    "java_handles": handles,
    "java_iterations": iterations,
    "call_sites": call_sites,
    "argument_dependency": dependency,
    "unresolved_types": unresolved,
    "entity_relations": relations,
    "lazy_accesses": lazy,
    "java_queries": annotated,
    "java_derived": derived,
    "method_query": method_query,
    "import_paths": imports,
    "containing_spans": spans,
    "resolve_handle": handle_scopes,
    "derived_decode": decode,
    "derived_render": render,
    "entity_table": entity_names,
}


def _per_customer(select, values, where="true"):
    return f"""
SELECT 'c' || c_custkey AS repo, {select} FROM customer, {values} WHERE {where}"""


_PATH = "replace(path, '{k}', CAST(c_custkey AS VARCHAR)) AS path"
_SPATH = f"replace('{SERVICE}', '{{k}}', CAST(c_custkey AS VARCHAR)) AS path"
_T = "c_custkey % 10 = t"

ORACLES = {
    "java_tokens": _per_customer(
        f"{_PATH}, n_tokens, deepest, last_line", sql_values(_token_rows(), "t, path, n_tokens, deepest, last_line"),
        f"t IS NULL OR c_custkey % {len(BODIES)} = t"),
    "java_types": _per_customer(
        f"{_PATH}, replace(name, '{{k}}', CAST(c_custkey AS VARCHAR)) AS name, kind, line, supertypes, first_argument, annotations",
        _TYPES),
    "java_methods": _per_customer(
        f"""{_PATH}, replace(name, '{{k}}', CAST(c_custkey AS VARCHAR)) AS name, line,
        replace(declaring_type, '{{k}}', CAST(c_custkey AS VARCHAR)) AS declaring_type, has_body""", _METHODS),
    "repository_closure": _per_customer(
        "type_name", "(VALUES ('Marked'), ('BaseRepo'), ('OrderRepository'), ('Sub')) x(type_name)"),
    "java_handles": _per_customer(f"{_SPATH}, identifier, repository_type, injection, line", _HANDLES, _T),
    "java_iterations": _per_customer(f"{_SPATH}, iteration_kind, line, element, element_type, iterable", _ITERATIONS, _T),
    "call_sites": _per_customer(
        f"""{_SPATH}, line, receiver, repository_type, resolution, injection, method_name, arguments,
        'S' || c_custkey AS enclosing_type, 'run' AS enclosing_method, nesting""", _SITES, _T),
    "argument_dependency": _per_customer("line, receiver, dependency, element", _SITES, _T),
    "unresolved_types": """
SELECT 'c' || c_custkey AS repo, 'AuditRepository' AS repository_type FROM customer WHERE c_custkey % 10 IN (5, 8)""",
    "entity_relations": _per_customer(
        f"'{ENTITY}' AS path, 'Customer' AS entity, field, accessor, association, line, 'customers_' || c_custkey AS table_name",
        "(VALUES ('orders', 'getOrders', 'OneToMany', 5), ('region', 'getRegion', 'ManyToOne', 7)) x(field, accessor, association, line)"),
    "lazy_accesses": _per_customer(
        f"""{_SPATH}, 18 AS line, 'c' AS receiver, 'Customer' AS entity, method_name, field, association,
        'run' AS enclosing_method, 1 AS nesting""",
        "(VALUES ('getOrders', 'orders', 'OneToMany'), ('getRegion', 'region', 'ManyToOne')) x(method_name, field, association)",
        "c_custkey % 10 = 9"),
    "java_queries": _per_customer(
        f"""'{REPOSITORY}' AS path, '{REPOSITORY}:' || name AS id, ordinal, kind, line,
        replace(text, '{{k}}', CAST(c_custkey AS VARCHAR)) AS text""", _ANNOTATED),
    "java_derived": _per_customer(
        f"'{REPOSITORY}' AS path, '{REPOSITORY}:' || name AS id, ordinal, line, text", _DERIVED),
    "method_query": _per_customer(
        f"'{REPOSITORY}' AS path, 'OrderRepository' AS repository_type, name, line, '{REPOSITORY}:' || query AS query_id",
        _METHOD_QUERIES),
    "import_paths": _per_customer(
        f"{_SPATH}, type_name, import_path",
        f"(VALUES ('OrderRepository', '{REPOSITORY}'), ('AuditRepository', 'src/main/java/com/acme/app/AuditRepository.java')) x(type_name, import_path)"),
    "containing_spans": """
WITH e AS (SELECT event_id AS k, 'f' || (user_id % 50) AS path FROM events)
SELECT 'r' AS repo, path, k AS off, 3 AS nesting, k // 3 * 3 AS innermost FROM e""",
    "resolve_handle": """
WITH e AS (SELECT event_id AS k, 'f' || (user_id % 50) AS path, event_type AS identifier FROM events),
h AS (SELECT * FROM e WHERE k % 5 < 3)
SELECT e.path, e.k AS off, e.identifier, CASE
  WHEN EXISTS (SELECT 1 FROM h WHERE h.path = e.path AND h.identifier = e.identifier AND h.k // 9 = e.k // 9) THEN 'narrow'
  WHEN EXISTS (SELECT 1 FROM h WHERE h.path = e.path AND h.identifier = e.identifier AND h.k // 27 = e.k // 27) THEN 'wide'
  WHEN EXISTS (SELECT 1 FROM h WHERE h.path = e.path AND h.identifier = e.identifier) THEN 'global' END AS repository_type
FROM e""",
    "derived_decode": f"""
SELECT p_partkey AS id, operation, predicates, ordering, row_limit FROM part JOIN {_NAMES} ON p_partkey % {len(NAMES)} = t""",
    "derived_render": f"""
SELECT p_partkey AS id, replace(text, '{{t}}', {_OWNER_TABLE}) AS text FROM part JOIN {_NAMES} ON p_partkey % {len(NAMES)} = t""",
    "entity_table": f"SELECT p_partkey AS id, {_OWNER_TABLE} AS table_name FROM part",
}
