"""Code extraction on small sources written here."""

from tessera.operators import calls, code

PY = '''
import os, a.b
from . import x
from ..pkg import y
LIMIT = 3
class A:
    def run(self):
        helper(1); self.go()
        bus.publish("orders", 1)
        requests.get(url)
def helper(n):
    return helper(n - 1)
print("top")
'''


def test_python_edges():
    got = {(s, t, k) for s, t, k, _, _ in code.python_edges("m.py", PY)}
    assert {("m.py", f"m.py::{n}", "contains") for n in ("LIMIT", "A", "run", "helper")} <= got
    assert {t for s, t, k in got if k == "imports"} == {"os", "a.b", ".", "..pkg"}
    assert {(s, t) for s, t, k in got if k == "calls"} == {("m.py::run", c) for c in ("helper", "go", "publish", "get")} | {("m.py::helper", "helper")}
    assert code.python_edges("b.py", "def (") == [] and code.python_edges("b.py", None) == []
    assert {(s, t) for s, t, *_ in code.python_integrations("m.py", PY)} == {("m.py::run", "PUBLISH orders"), ("m.py::run", "HTTP GET <var:url>")}


def test_other_languages(spark):
    files = spark.createDataFrame(
        [
            ("m.py", PY),
            ("a.go", 'package a\nimport "fmt"\nfunc (s *S) Run() {}\ntype S struct{}\nfunc main() {\n e.GET("/u/:id", h.Get)\n}'),
            ("b.ts", "import x from './x'\nexport class C {}\nconst f = () => 1\nrouter.post('/p', auth, create)\n"),
            ("c.rb", "class User\n  def name?\n    helper 'x'\n  end\nend\n"),
            ("config/routes.rb", "get 'x', to: 'users#show'"),
        ],
        "path string, content string",
    )
    got = {(r.source_node, r.target_node, r.edge_type) for r in code.extract(files, ["echo", "express", "rails"]).collect()}
    assert {("a.go", "a.go::Run", "contains"), ("a.go", "a.go::S", "contains"), ("a.go", "fmt", "imports"), ("GET /u/:id", "Get", "http"), ("a.go::main", "GET", "calls")} <= got
    assert {("b.ts", "./x", "imports"), ("b.ts", "b.ts::C", "contains"), ("b.ts", "b.ts::f", "contains"), ("POST /p", "create", "http")} <= got
    assert {("c.rb", "c.rb::User", "contains"), ("c.rb", "c.rb::name?", "contains"), ("GET /x", "users#show", "http"), ("c.rb::name?", "helper", "calls"), ("auth", "create", "middleware")} <= got
    found = code.frameworks(spark.createDataFrame([("x/go.mod", "module m\nrequire github.com/labstack/echo/v4 v4"), ("package.json", '{"dependencies": {"express": "1"}}')], "path string, content string"))
    assert {r.framework for r in found.collect()} == {"go", "echo", "express"}


def test_resolve_imports(spark):
    imports = spark.createDataFrame([("src/a/m.ts", s) for s in ("./x", "../y", "../../../up", "~/lib/z", "@utils", "@utils/q", "react", "./none", "")], "source_file string, specifier string")
    files = spark.createDataFrame([(p,) for p in ("src/a/x.ts", "src/y/index.vue", "app/lib/z.js", "src/utils.ts", "app/x.ts")], "path string")
    aliases = spark.createDataFrame([("~/", "app"), ("@utils", "src/utils")], "prefix string, root string")
    got = {r.specifier: r.target for r in code.resolve_imports(imports, files, aliases).collect()}
    assert got == {"./x": "src/a/x.ts", "../y": "src/y/index.vue", "../../../up": "../../../up", "~/lib/z": "app/lib/z.js", "@utils": "src/utils.ts", "@utils/q": "@utils/q", "react": "react", "./none": "./none", "": ""}


def pairs(made, kind=None):
    return {(s, t) for s, t, k, *_ in made if kind in (None, k)}


def test_calls_of_go():
    src = """package a
// helper(1) in a comment
func (s *Server) Run(ctx context.Context) error {
	s.load("load(2)")
	if err := check(x); err != nil { return wrap(err) }
	bus.Publish(ctx, "orders", m)
	client.Get("http://a/b")
	go func() { inner() }()
	return nil
}
func main() { Run() }
"""
    made = calls.edges_of("a.go", src)
    assert {t for s, t in pairs(made, "calls") if s == "a.go::Run"} == {"load", "check", "wrap", "Publish", "Get", "inner"}
    assert ("a.go::main", "Run") in pairs(made, "calls") and pairs(made, "integration") == {("a.go::Run", "PUBLISH orders"), ("a.go::Run", "HTTP GET http://a/b")}
    assert {line for s, t, _, _, line in made if t == "check"} == {5}


def test_calls_of_scripts():
    src = """import x from './x'
const load = async (id) => { const r = await axios.get(`/u/${id}`); return parse(r.data) }
const short = a => trim(a)
function outer() {
  return inner(function () { deep() })
}
class Service {
  async save(item: Item): Promise<void> {
    this.repo.store(item) // not.called()
    emitter.emit('saved', item)
  }
}
queue.on('saved', handle)
fetch('/ping')
"""
    made = calls.edges_of("s.ts", src)
    got = pairs(made, "calls")
    assert {("s.ts::load", "parse"), ("s.ts::short", "trim"), ("s.ts::outer", "inner"), ("s.ts::outer", "deep"), ("s.ts::save", "store"), ("s.ts::save", "emit")} <= got and not any(t == "called" for _, t in got)
    assert {("s.ts::save", "PUBLISH saved"), ("s.ts::<module>", "CONSUME saved"), ("s.ts::<module>", "HTTP GET /ping")} <= pairs(made, "integration") and any(t.startswith("HTTP GET <var:") for _, t in pairs(made, "integration"))
    vue = calls.edges_of("v.vue", "<template><a @click='no()'/></template>\n<script setup>\nfunction go() { run() }\n</script>")
    assert pairs(vue) == {("v.vue::go", "run")} and vue[0][4] == 3
    assert calls.edges_of("e.js", None) == [] and calls.edges_of("e.js", "function broken( {") == []


def test_calls_of_ruby():
    src = """class Job < Base
  def perform(id)
    user = User.find(id) # no.call(1)
    notify user, "text find(3)"
    MailJob.perform_later(user)
  end
  def self.build
    new_thing(1)
  end
end
"""
    made = calls.edges_of("j.rb", src)
    assert {("j.rb::perform", "find"), ("j.rb::perform", "notify"), ("j.rb::build", "new_thing")} <= pairs(made, "calls") and ("j.rb::perform", "PUBLISH MailJob") in pairs(made, "integration")
    assert not any(t == "call" for _, t in pairs(made))


def test_routes_by_framework():
    rails = """Rails.application.routes.draw do
  root to: 'home#index'
  resources :users, only: [:index, :show] do
    resources :posts, except: %i[new edit destroy]
    member do
      post :ban
    end
    get :search, on: :collection
  end
  namespace :api do
    resource :session, only: :create
    get 'health', to: 'status#show'
  end
end
"""
    got = pairs(calls.rails_routes("config/routes.rb", rails))
    assert {("GET /", "home#index"), ("GET /users", "users#index"), ("GET /users/:id", "users#show"), ("POST /users/:user_id/posts", "posts#create"), ("POST /users/:id/ban", "users#ban"), ("GET /users/search", "users#search"), ("POST /api/session", "api/sessions#create"), ("GET /api/health", "api/status#show")} <= got
    assert not {("POST /users", "users#create"), ("GET /users/:user_id/posts/new", "posts#new")} & got
    assert [calls.nuxt_routes(p)[0][0] for p in ("pages/index.vue", "pages/u/[id].vue", "app/pages/[...slug].vue", "server/api/items/[id].delete.ts", "server/api/x.ts")] == ["GET /", "GET /u/:id", "GET /*slug", "DELETE /api/items/:id", "ANY /api/x"]
    assert calls.nuxt_routes("components/a.vue") == []
    echo = 'v1 := e.Group("/v1", mw.Auth)\nadmin := v1.Group("/admin")\nadmin.Use(onlyAdmins)\nadmin.POST("/u", h.Create, limit)\ne.GET("/", h.Home)'
    got = calls.grouped_routes("r.go", echo)
    assert pairs(got, "http") == {("POST /v1/admin/u", "Create"), ("GET /", "Home")} and pairs(got, "middleware") == {("Auth", "Create"), ("onlyAdmins", "Create"), ("limit", "Create")}
    gin = 'r := gin.Default()\ng := r.Group("/g")\ng.GET("/x", guard, show)'
    assert pairs(calls.grouped_routes("g.go", gin)) == {("GET /g/x", "show"), ("guard", "show")}
    express = "router.use(log)\nrouter.get('/a', auth, users.list)\napp.all('/b', (req, res) => res.send(1))"
    assert pairs(calls.express_routes("e.js", express)) == {("GET /a", "list"), ("log", "list"), ("auth", "list"), ("ANY /b", "<inline>")}
    nest = "@Controller('cats')\nexport class CatsController {\n  @Get(':id')\n  @UseGuards(A)\n  async one(@Param() p) {}\n  @Post()\n  make() {}\n}"
    assert pairs(calls.nest_routes("c.ts", nest)) == {("GET /cats/:id", "CatsController.one"), ("POST /cats", "CatsController.make")}


def test_ruby_classes_and_symbols(spark):
    edges = spark.createDataFrame([("a.rb::run", "Admin::UserMailer.send_it", "calls", "a.rb", 1), ("a.rb::run", "plain", "calls", "a.rb", 2), ("a.rb::run", "old.rb::x", "reconcile", "a.rb", 3)], "source_node string, target_node string, edge_type string, source_file string, line long")
    classes = spark.createDataFrame([("spec/user_mailer.rb", "UserMailer"), ("app/mailers/user_mailer.rb", "UserMailer"), ("lib/user_mailer.rb", "UserMailer"), ("app/all.rb", "UserMailer")], "path string, symbol string")
    got = {(r.target_node, r.edge_type) for r in code.resolve_ruby(edges, classes).collect()}
    assert got == {("Admin::UserMailer.send_it", "calls"), ("plain", "calls"), ("app/mailers/user_mailer.rb::send_it", "reconcile")}
    files = spark.createDataFrame([("m.py", PY), ("a.go", "package a\nfunc Run() {}\n")], "path string, content string")
    assert {("m.py", "helper", 11), ("a.go", "Run", 2)} <= {tuple(r) for r in code.symbols(files).collect()}
