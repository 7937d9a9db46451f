import pytest

from codequarry.detect.access import analyse
from codequarry.php.facts import Facts, extract
from codequarry.php.lexer import class_declaration, strip_comments, tokenize
from codequarry.php.parser import parse

MODEL = """<?php
namespace App\\Models;
use Illuminate\\Database\\Eloquent\\Model;
class Invoice extends Model {
    protected $fillable = ['user_id', 'amount'];
}
"""
ACCOUNT = """<?php
namespace App\\Models;
use Illuminate\\Foundation\\Auth\\User as Authenticatable;
class Account extends Authenticatable {
    protected $fillable = [
        'name', 'password',
        'is_admin',
        'is_active',
    ];
}
"""
HEAD = """<?php
namespace App\\Http\\Controllers;
use App\\Models\\Invoice;
use App\\Models\\Account;
use Illuminate\\Http\\Request;
use Illuminate\\Support\\Facades\\Http;
"""
CONTROLLER = HEAD + """class InvoiceController extends Controller {
    public function show($id) {
        $invoice = Invoice::findOrFail($id);
        return response()->json($invoice);
    }
    public function mine($id) {
        return Invoice::where('user_id', auth()->id())->where('id', $id)->firstOrFail();
    }
    public function checked($id) {
        $invoice = Invoice::find($id);
        $this->authorize('view', $invoice);
        return $invoice;
    }
    public function delegated($id) {
        $invoice = Invoice::findOrFail($id);
        $this->mayRead($invoice);
        return $invoice;
    }
    private function mayRead($invoice) {
        abort_unless($invoice->user_id === auth()->id(), 403);
    }
    public function preview(Request $request) {
        return Http::get($request->input('url'))->body();
    }
    public function fixed(Request $request) {
        return Http::get('https://api.example.org/items/' . $request->input('item'))->body();
    }
    public function listed(Request $request) {
        $url = $request->input('url');
        if (! in_array($url, ['https://a.example.org'], true)) { return null; }
        return Http::get($url)->body();
    }
    public function profile(Account $account) {
        return response()->json(['key' => $account->api_key, 'name' => $account->name]);
    }
    public function register(Request $request) {
        return Account::create($request->all());
    }
    public function rename(Request $request, Account $account) {
        $account->update($request->only(['name']));
    }
}
"""
POLICY = """<?php
namespace App\\Policies;
class InvoicePolicy { public function update($user, $invoice) { return $user->id === $invoice->user_id; } }
"""
EDITOR = HEAD + """class EditorController extends Controller {
    public function update(Request $request, Invoice $invoice) {
        $invoice->amount = 1;
        $invoice->save();
    }
}
"""
ROUTES = """<?php
use App\\Http\\Controllers\\InvoiceController;
use App\\Http\\Controllers\\EditorController;
use Illuminate\\Support\\Facades\\Route;
Route::middleware(['auth'])->prefix('v1')->group(function () {
    Route::get('/invoices/{id}', [InvoiceController::class, 'show']);
    Route::get('/mine/{id}', [InvoiceController::class, 'mine']);
    Route::get('/delegated/{id}', [InvoiceController::class, 'delegated']);
    Route::get('/checked/{id}', [InvoiceController::class, 'checked']);
    Route::put('/edit/{invoice}', [EditorController::class, 'update']);
});
Route::resource('photos', App\\Http\\Controllers\\PhotoController::class)->only(['index', 'show']);
"""
FILES = [("app/Models/Invoice.php", MODEL), ("app/Models/Account.php", ACCOUNT), ("app/Http/Controllers/InvoiceController.php", CONTROLLER), ("app/Policies/InvoicePolicy.php", POLICY), ("app/Http/Controllers/EditorController.php", EDITOR), ("routes/web.php", ROUTES), ("app/Broken.php", "<?php class {")]


@pytest.fixture(scope="module")
def found(spark):
    facts = Facts(spark.createDataFrame(FILES, "path string, content string"))
    return facts, analyse(facts).collect()


def of(found, type_):
    return {(r.method, r["class"], r.confidence) for r in found[1] if r.type == type_}


def test_records_by_id(found):
    assert ("show", "vulnerability", "proven") in of(found, "idor")
    assert not {m for m, *_ in of(found, "idor")} & {"mine", "checked", "delegated"}


def test_policy_gap_takes_the_place_of_the_record(found):
    assert of(found, "auth_bypass") == {("update", "vulnerability", "proven")} or of(found, "auth_bypass") == {("update", "review", "possible")}
    assert "update" not in {m for m, *_ in of(found, "idor")}


def test_addresses(found):
    assert {m for m, *_ in of(found, "ssrf")} == {"preview"}


def test_secrets_in_responses(found):
    assert of(found, "sensitive_data_exposure") == {("profile", "vulnerability", "proven")}


def test_privileges(found):
    rows = {r.description: r for r in found[1] if r.type == "mass_assignment"}
    hit = [r for d, r in rows.items() if "is_admin" in d]
    assert len(hit) == 1 and hit[0]["class"] == "vulnerability" and hit[0].method == "register"
    assert any("is_active" in d for d in rows) and not any("name" in d.split() for d in rows)


def test_broken_file_is_an_error(found):
    assert [r.path for r in found[0].errors.collect()] == ["app/Broken.php"]


def test_routes(found):
    rows = {(r.verb, r.uri, r.method): r.middleware for r in found[0].routes.collect()}
    assert rows["GET", "/v1/invoices/{id}", "show"] == ["auth"]
    assert {k for k in rows if "photos" in k[1]} == {("GET", "/photos", "index"), ("GET", "/photos/{photo}", "show")}


def test_a_model_nobody_has_read_raises_a_question(spark):
    facts = Facts(spark.createDataFrame([f for f in FILES if "Models" not in f[0]], "path string, content string"))
    rows = {(r.method, r.type, r["class"]) for r in analyse(facts).collect()}
    assert ("show", "idor", "review") in rows and ("profile", "sensitive_data_exposure", "vulnerability") in rows and ("preview", "ssrf", "vulnerability") in rows


def test_without_routes_a_route_parameter_says_nothing(spark):
    facts = Facts(spark.createDataFrame(FILES[:3], "path string, content string"))
    assert not [r for r in analyse(facts).collect() if r.type == "idor" and r["class"] == "vulnerability"]


def test_lexer_keeps_lines():
    code = "<?php\n$a = '/* no */'; // yes\n/* two\nlines */\n$b = 1; # end\n"
    out = strip_comments(code)
    assert out.count("\n") == code.count("\n") and "'/* no */'" in out and "yes" not in out and "end" not in out
    assert [t.line for t in tokenize(code) if t.kind == "var"] == [2, 5]
    assert class_declaration("<?php namespace A\\B; $x = new class {}; final class C extends \\D\\E {}") == {"namespace": "A\\B", "class": "C", "fqcn": "A\\B\\C", "extends": "\\D\\E"}


@pytest.mark.parametrize("code", [
    "$x = $a?->b['c'] ?? fn($y) => $y + 1;", "match(true) { $a > 1 => 'x', default => throw new \\E() };", "foreach ($a as $k => [$b, $c]): echo $b; endforeach;", "enum S: string { case A = 'a'; const B = self::A; public function f(): string { return $this->value; } }",
    "$s = <<<EOT\n  hi {$a['b']} $c->d\n  EOT;", "class P { public function __construct(private readonly ?int $x = null, string|array ...$y) {} use T { a as b; } }", "list('a' => $b) = f(...$args); static fn() => 1; unset($a, $b);", "#[Attr(1)] function g(): ?static { yield $a => $b; }", "if ($a instanceof B and !$c): elseif (1): else: endif; try { } catch (A|B) { } finally { }",
])
def test_parser_reads(code):
    assert parse("<?php " + code)


def test_extract_is_total():
    assert extract("x.php", "")[:1] == [] and extract("x.php", "<?php $a = ")[0][0] == "errors"
